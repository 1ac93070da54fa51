"""Personal data: detection, and keyed surrogates in place of what is found.

Everything is DataFrame and SQL expressions. One pattern finds e-mail addresses, phone numbers, IPv4 addresses, card and account
numbers, social security numbers, secrets after a label, and names after a title (which gives the gender). An entity is
a kind and a canonical form (case and separators aside), so an entity has one surrogate wherever and however it is
written. A surrogate is drawn from HMAC-SHA-512 (by key) of kind, form and attempt: letters become letters of the same script
and case, digits digits, separators stay; octets stay valid and of their length, a valid card number stays valid (Luhn), and so does a
valid account number (remainder 1 of 97, country kept); e-mail domains are entities of their own that keep their top-level domain,
and names are composed of syllables of their script with an ending of their gender. Collision checks: a surrogate that another entity has, or that is itself an entity of the corpus, is drawn
again, so distinct entities stay distinct and no real value is put in another's place. An address draws its local part only, and is
compared with the others of its domain; domains have distinct surrogates that are no real domains, so this holds for the
addresses as written. A local part or domain grows by a letter with each third attempt, as short ones run out.

The pattern runs once over each text: texts, cut at their entities, are written once as compressed Parquet in the shared folder.
An entity of over 1 / 4,096 of all occurrences gets its surrogates by a broadcast join, so no key of the shuffled join is hot.

Defined results: a null text stays null and an empty text empty, with no entities; repeated rows are treated alike; null ids are
kept; an empty table gives an empty result; very long texts are treated whole; columns other than id and text are not read by
pseudonymise, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import checkpointed, joined_hot, run_folder, settled, with_rid

# Titles by gender.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "Lord", "Don", "г-н", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Lady", "Doña", "г-жа", "госпожа", "κυρία")
# Alphabets and syllables by script.
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "han": "安白北春大东方风高光海和花江金李林明南平青山石天王文西小新雪阳叶云张中"}
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ka ke ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бо ва ве ви да де ди до га го ка ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε βο γα γε γο δα δε δι δο κα κε κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
    "han": list("安白北春东方风高光海和花江金李林明南平青山石天王文西小新雪阳叶云张中"),
}
ENDINGS = {"latin": {"f": "ia", "m": "us", "s": "er"}, "cyrillic": {"f": "ия", "m": "ан", "s": "ко"}, "greek": {"f": "ία", "m": "ος", "s": "ης"}, "han": {"f": "丽", "m": "强", "s": "国"}}

_TITLE = "|".join(sorted((*MALE, *FEMALE), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]+|\p{IsHan}{1,4}"
#: Alternatives that start with a like character stand behind one look at it.
PATTERN = "|".join(
    (
        r"(?<=[=: \t\"'])(?=[A-Za-z0-9_/+=-]{12})(?<=(?i:token|secret|password|passwd|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?)(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{12,}+",
        r"(?=[A-Za-z0-9])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
        r"(?=\d)(?:" + "|".join(
            (
                rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
                r"(?<![\dA-Za-z+])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\dA-Za-z])",
                r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
                r"(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
            )
        ) + ")",
        r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?=[+(])(?:(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d))",
        rf"(?=[\p{{Lu}}\p{{IsHan}}])(?<= )(?<=(?<![\p{{L}}])(?:{_TITLE})\.? )(?:{_WORD})(?: (?:{_WORD})){{0,2}}",
    )
)
#: A text with none of these has no entity; it saves the pattern.
HINT = rf"[0-9@]|[=:]|(?:{_TITLE})\.? "


#: What stands around an entity while a text is cut, and what stands for a text's own first character of it.
EDGE, ESCAPED = "\u0001\u0003", "\u0001\u0002"


def pieces(text: Column) -> Column:
    """A text cut at its entities: what is between them, and they, in turn. The pattern runs once."""
    marked = F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit(ESCAPED)), PATTERN, f"{EDGE}$0{EDGE}")
    whole = F.transform(F.split(marked, EDGE, -1), lambda p: F.replace(p, F.lit(ESCAPED), F.lit("\u0001")))
    return F.when(text.rlike(HINT), whole).otherwise(F.array(text))


def kind_of(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^\d[\d -]*$") & (digits >= 13), "card")
        .when(value.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$") & (F.length(value) >= 15), "account")
        .when(value.rlike(r"^[+(\d][\d +().-]*$"), "phone")
        .when(value.rlike(r"^[\p{L}\p{M}'’ -]+$") & (value.contains(" ") | ~value.rlike("^[A-Za-z]{12,}$")), "name")
        .otherwise("secret")
    )


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").when(value.rlike(r"\p{IsHan}"), "han").otherwise("latin")


def canonical(kind: Column, value: Column) -> Column:
    bare = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    return F.when(kind.isin("card", "phone", "ssn", "account"), F.lower(bare)).when(kind == "secret", value).otherwise(F.lower(value))


def draw(digest: Column, i: Column, n: Column | int) -> Column:
    """A number below n from the bytes of a hex digest at i (from 1); long values come round again."""
    at = F.pmod(i * 4, F.lit(240)) + 1
    return F.pmod(F.conv(digest.substr(at.cast("int"), F.lit(4)), 16, 10).cast("long") + i, n if isinstance(n, Column) else F.lit(n))


def one_of(choices: str | list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (k + 1).cast("int"))


def like_letters(value: Column, digest: Column, hexes: bool = False) -> Column:
    """Letters and digits drawn anew, each in its script and case; all else stays. An account keeps its country."""

    def char(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        out = F.when(c.rlike("[0-9]"), one_of("0123456789", draw(digest, i, 10)))
        latin = "abcdef" if hexes else ALPHABETS["latin"]
        for letters, form in ((latin, "[a-z]"), (latin.upper(), "[A-Z]"), *((x.upper() if big else x, rf"(?=\p{{L{'u' if big else 'l'}}})\p{{Is{s.capitalize()}}}") for s, x in ALPHABETS.items() for big in (0, 1) if s in ("cyrillic", "greek"))):
            out = out.when(c.rlike(form), one_of(letters, draw(digest, i, len(letters))))
        return out.when(c.rlike(r"\p{IsHan}"), one_of(ALPHABETS["han"], draw(digest, i, len(ALPHABETS["han"])))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), char), "")


def luhn(digits: Column, n: Column) -> Column:
    """The Luhn sum of n digits."""
    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x)


def mod97(account: Column) -> Column:
    """The remainder of an account number in canonical form: its first four characters go last, a letter counts as two digits."""
    n = F.length(account)
    turned = F.concat(account.substr(F.lit(5), n), account.substr(1, 4))
    worth = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 87)
    chars = F.transform(F.sequence(F.lit(1), n), lambda i: worth(F.substring(turned, i, F.lit(1))))
    return F.aggregate(chars, F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 in hex."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 512))), 512)


def composed(syllables: list[str], digest: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: one_of(syllables, draw(digest, i, len(syllables)))), "")


def surrogate(kind: Column, form: Column, digest: Column, attempt: Column) -> Column:
    """In canonical form."""
    plain = like_letters(form, digest)
    octet = lambda o, i: F.when((F.length(o) == 3) | (attempt > 8), 100 + draw(digest, i, 156)).when(F.length(o) == 2, 10 + draw(digest, i, 90)).otherwise(1 + draw(digest, i, 9)).cast("string")
    ip = F.array_join(F.transform(F.split(form, r"\."), lambda o, i: octet(o, i + 1)), ".")
    n = F.length(form)
    body = F.concat(plain.substr(F.lit(1), n - 1), F.lit("0"))
    card = F.when(F.pmod(luhn(form, n), F.lit(10)) == 0, F.concat(plain.substr(F.lit(1), n - 1), F.pmod(10 - F.pmod(luhn(body, n), F.lit(10)), F.lit(10)).cast("string"))).otherwise(plain)
    country, rest = form.substr(1, 2), like_letters(form.substr(F.lit(5), n), digest)
    check = F.when(mod97(form) == 1, F.lpad((98 - mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")).otherwise(like_letters(form.substr(3, 2), digest))
    account = F.concat(country, check, rest)
    code = F.greatest(n - 10, F.lit(0))  # a phone number keeps its country code
    phone = F.concat(form.substr(F.lit(1), code), like_letters(form.substr(code + 1, n), digest))
    out = F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "account", account).when(kind == "phone", phone)
    grown = F.concat(F.substring_index(form, "@", 1), F.repeat(F.lit("a"), F.floor(attempt / 3).cast("int")))
    out = out.when(kind == "email", F.concat_ws("@", like_letters(grown, digest), F.substring_index(form, "@", -1)))  # the domain is only compared by
    top = F.substring_index(form, ".", -1)
    named = F.concat(form.substr(F.lit(1), n - F.length(top) - 1), F.repeat(F.lit("a"), F.floor(attempt / 3).cast("int")))
    out = out.when(kind == "domain", F.concat_ws(".", like_letters(named, digest), top))
    out = out.when(kind == "secret", F.when(form.rlike("^[0-9a-f]+$") | form.rlike("^[0-9A-F]+$"), like_letters(form, digest, True)).otherwise(plain))
    for script, syllables in SYLLABLES.items():
        for gender in "fms":
            size = (1 if script == "han" else 2) + F.floor(attempt / 3)
            name = composed(syllables, digest, size)
            out = out.when(kind == f"name_{gender}_{script}", F.concat(name, F.lit(ENDINGS[script][gender])))
    return out.otherwise(plain)


def entities(every: DataFrame, key: str) -> DataFrame:
    """every: _kind, _form, distinct. _kind, _form and _surrogate of each, by rounds of drawing and collision checks."""
    todo, done = every.select("_kind", "_form", F.lit(0).alias("_attempt")), None
    while True:
        digest = F.concat(*(hmac(key, F.concat_ws("\u0001", F.lit(part), "_kind", "_attempt", "_form")) for part in "ab"))
        drawn = todo.withColumn("_digest", digest).withColumn("_surrogate", surrogate(F.col("_kind"), F.col("_form"), F.col("_digest"), F.col("_attempt"))).drop("_digest")
        real = every.select("_kind", F.col("_form").alias("_surrogate"))
        taken = real if done is None else real.unionByName(done.select("_kind", "_surrogate"))
        free = drawn.join(taken, ["_kind", "_surrogate"], "left_anti")
        first = free.withColumn("_nth", F.row_number().over(Window.partitionBy("_kind", "_surrogate").orderBy("_form"))).where("_nth = 1").select("_kind", "_form", "_surrogate")
        done = checkpointed(first if done is None else done.unionByName(first))
        todo = checkpointed(todo.join(done, ["_kind", "_form"], "left_anti").withColumn("_attempt", F.col("_attempt") + 1))
        if todo.isEmpty():
            return done


def shown(kind: Column, surface: Column, form: Column) -> Column:
    """A surrogate written as the surface is: its separators, and its case. Of an address, the local part."""
    nth = lambda i: F.length(F.regexp_replace(surface.substr(F.lit(1), i), "[^0-9A-Za-z]", ""))
    bare = F.transform(F.sequence(F.lit(1), F.length(surface)), lambda i: F.when(F.substring(surface, i, F.lit(1)).rlike("[0-9A-Za-z]"), F.substring(form, nth(i), F.lit(1))).otherwise(F.substring(surface, i, F.lit(1))))
    part = lambda x: F.when(kind == "email", F.substring_index(x, "@", 1)).otherwise(x)
    same = F.transform(F.sequence(F.lit(1), F.length(part(form))), lambda i: F.when(F.substring(part(surface), i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(form, i, F.lit(1)))).otherwise(F.substring(form, i, F.lit(1))))
    upper = F.upper(F.array_join(bare, ""))
    name = F.when((surface == F.upper(surface)) & (F.length(surface) > 1), F.upper(form)).otherwise(F.initcap(form))
    return F.when(kind.isin("card", "phone", "ssn"), F.array_join(bare, "")).when(kind == "account", upper).when(kind.startswith("name"), name).when(kind.isin("email", "domain"), F.array_join(same, "")).otherwise(form)


def split_entity(kind: Column, value: Column, gender: Column) -> Column:
    """The parts of an entity that have surrogates: an address's local part and domain, a name's words; else the whole."""
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("surface"))
    words = F.split(value, " ")
    last = F.size(words) - 1
    name = F.transform(words, lambda w, i: one(F.concat(F.lit("name_"), F.when((i == last), "s").otherwise(gender), F.lit("_"), script_of(w)), w))
    address = F.array(one(F.lit("email"), value), one(F.lit("domain"), F.substring_index(value, "@", -1)))
    return F.when(kind == "email", address).when(kind == "name", name).otherwise(F.array(one(kind, value)))


KINDS = ("email", "phone", "ip", "card", "account", "ssn", "secret", "name")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_entities, a count of each kind, and the text with surrogates, for each row."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession, "pii")
    rows = with_rid(settled(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).select("_rid", "_id", pieces(F.col("_text")).alias("_pieces"))
    rows.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    hits, clean = rows.where(F.size("_pieces") > 1), rows.where(F.size("_pieces") == 1)
    male = rf"(?:^|[^\p{{L}}])(?:{'|'.join(MALE)})\.? $"
    pair = lambda i: F.struct(F.get("_pieces", 2 * i + 1).alias("_found"), F.substring(F.get("_pieces", 2 * i), -12, 12).rlike(male).alias("_male"))
    each = hits.select("_rid", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.size("_pieces") - 3) / 2).cast("int")), pair)).alias("_at", "_e")).withColumn("_k", kind_of(F.col("_e._found")))
    parts = each.select("_rid", "_at", F.col("_k").alias("_type"), F.posexplode(split_entity(F.col("_k"), F.col("_e._found"), F.when(F.col("_e._male"), "m").otherwise("f"))).alias("_sub", "_p"))
    parts = checkpointed(parts.select("_rid", "_at", "_type", "_sub", F.col("_p.kind").alias("_kind"), F.col("_p.surface").alias("_surface"), canonical(F.col("_p.kind"), F.col("_p.surface")).alias("_form")))
    every = checkpointed(parts.groupBy("_kind", "_form").agg(F.count(F.lit(1)).alias("_n")))
    known, total = entities(every, key), every.agg(F.sum("_n")).first()[0] or 0
    told = joined_hot(parts, checkpointed(known.join(every, ["_kind", "_form"])), ["_kind", "_form"], "_n", total)
    told = told.select("_rid", "_at", "_type", "_sub", shown(F.col("_kind"), F.col("_surface"), F.col("_surrogate")).alias("_new"))
    whole = told.groupBy("_rid", "_at").agg(F.first("_type").alias("_type"), F.transform(F.array_sort(F.collect_list(F.struct("_sub", "_new"))), lambda x: x["_new"]).alias("_news"))
    new = F.when(F.col("_type") == "email", F.array_join("_news", "@")).otherwise(F.array_join("_news", " "))
    by_row = whole.select("_rid", F.struct("_at", new.alias("_new"), "_type").alias("_x")).groupBy("_rid").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    text = F.array_join(F.transform("_pieces", lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get("_xs", ((i - 1) / 2).cast("int"))["_new"])), "")
    count = lambda k: F.size(F.filter("_xs", lambda x: x["_type"] == k)).cast("long").alias(f"n_{k}")
    changed = hits.join(by_row, "_rid").select("_id", F.size("_xs").cast("long").alias("n_entities"), *map(count, KINDS), text.alias("_text"))
    clean = clean.select("_id", F.lit(0).cast("long").alias("n_entities"), *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS), F.get("_pieces", F.lit(0)).alias("_text"))
    return changed.unionByName(clean).select(F.col("_id").alias(id_col), "n_entities", *(f"n_{k}" for k in KINDS), F.col("_text").alias(text_col))
