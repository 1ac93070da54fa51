"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import run_folder, table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).drop("set_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from larkspur.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Rules of op3: rule (host and path) and verdict.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.url_filters import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key=spark.conf.get("spark.larkspur.pii.key", "a key for tests"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.warc import read_archives, write_archives

    folder = run_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.hmm import score

    return score(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Blanks of the words of documents, as a class of a pattern.
BLANK = r"[\x20\x09-\x0D]"
RATIOS = ("word_length", "symbols", "dup_lines", "repeats")


def jaccard_sql() -> str:
    """Shingles as text; all pairs that share one; components by reachability."""
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.size + y.size - shared)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT d.doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
        FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON least.a = d.doc_id LEFT JOIN many ON many.a = d.doc_id"""


def rules_sql() -> str:
    """Counts; buckets of ratios by language and source, of the language and of all; quartiles, drawn together; fences."""
    g = "((1 + 0.01::DOUBLE) / (1 - 0.01::DOUBLE))"
    floors = {"word_length": 1.0, "symbols": 0.03, "dup_lines": 0.15, "repeats": 0.06}

    def quartiles(name: str, *by: str) -> str:
        part = "PARTITION BY " + ", ".join([*by, "ratio"])
        keys = ", ".join([*by, "ratio"])
        at = lambda q: f"min(CASE WHEN upto >= greatest(ceil(n * {q}::DOUBLE), 1) THEN bucket END)"
        middle = lambda b: f"CASE WHEN {b} = -100000 THEN 0.0 ELSE 2 * pow({g}, {b}) / ({g} + 1) END"
        return f"""{name}_b AS (SELECT {keys}, bucket, count(*) AS c FROM buckets GROUP BY ALL),
            {name} AS (SELECT {keys}, max(n) AS n, {middle(at(0.25))} AS q1, {middle(at(0.75))} AS q3
                FROM (SELECT *, sum(c) OVER ({part} ORDER BY bucket) AS upto, sum(c) OVER ({part}) AS n FROM {name}_b) GROUP BY {keys})"""

    drawn = lambda n, q, to: f"(({n}::DOUBLE * {n} / ({n}::DOUBLE * {n} + 2500)) * {q} + (1 - {n}::DOUBLE * {n} / ({n}::DOUBLE * {n} + 2500)) * {to})"
    q1, q3 = (drawn("own.n", f"own.{q}", drawn("l.n", f"l.{q}", f"every.{q}")) for q in ("q1", "q3"))
    floor = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in floors.items())
    return f"""
        WITH w AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
        windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n
            FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))),
        again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM windows WHERE n > 1) GROUP BY doc_id),
        c AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN again USING (doc_id)),
        f AS (SELECT *, word_chars::DOUBLE / greatest(n_words, 1) AS ratio_word_length, n_symbols::DOUBLE / greatest(n_words, 1) AS ratio_symbols,
                n_dup_lines::DOUBLE / greatest(n_lines, 1) AS ratio_dup_lines, n_repeat_words::DOUBLE / greatest(n_words, 1) AS ratio_repeats,
                n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
        each AS (SELECT doc_id, lang, source, unnest([{', '.join(f"'{r}'" for r in RATIOS)}]) AS ratio, unnest([{', '.join(f'ratio_{r}' for r in RATIOS)}]) AS v FROM f WHERE n_words > 0),
        buckets AS (SELECT *, CASE WHEN v < 1e-4 THEN -100000 ELSE ceil(ln(v) / ln({g}))::INT END AS bucket FROM each),
        {quartiles('own', 'lang', 'source')}, {quartiles('l', 'lang')}, {quartiles('every')},
        q AS (SELECT own.lang, own.source, own.ratio, {q1} AS q1, {q3} AS q3
            FROM own JOIN l ON own.lang IS NOT DISTINCT FROM l.lang AND own.ratio = l.ratio JOIN every ON own.ratio = every.ratio),
        fences AS (SELECT *, 3.0 * greatest(q3 - q1, CASE ratio {floor} END) AS spread FROM q),
        beyond AS (SELECT DISTINCT doc_id FROM each e JOIN fences x ON e.lang IS NOT DISTINCT FROM x.lang AND e.source IS NOT DISTINCT FROM x.source AND e.ratio = x.ratio
            WHERE v > q3 + spread OR (e.ratio = 'word_length' AND v < q1 - spread))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept,
               {', '.join(f'ratio_{r}' for r in RATIOS)} FROM f"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard_sql(),
        "op9_quality_rules": rules_sql(),
        "op4_exact_dedup": """
            WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
            FROM t""",
        "op7_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
            five AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::INT) AS v FROM p),
            b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x:
                    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1) ||
                    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest FROM five),
            m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM b)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> top THEN top END AS refers_to
            FROM m""",
    }
