"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .job import table


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import document_audio

    return document_audio(table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_suffixes

    return dedup_suffixes(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    return classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_dedup import dedup_windows

    return dedup_windows(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_SUFFIX_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
    b AS (SELECT doc_id, digits, unnest(range((length(digits) // 2 - 199 + 255) // 256)) AS j FROM d WHERE length(digits) >= 400),
    p AS (SELECT doc_id, 256 * j AS first, substr(digits, 512 * j + 1, 910) AS part FROM b),
    w AS (SELECT doc_id, unnest(list_transform(range(length(part) // 2 - 199), lambda s: md5_number(substr(part, 2 * s + 1, 400)))) AS print, first + unnest(range(length(part) // 2 - 199)) AS start FROM p),
    f AS (SELECT doc_id, start FROM w JOIN (SELECT print FROM w GROUP BY print HAVING count(*) > 1) USING (print)),
    r AS (SELECT doc_id, start, coalesce(start > lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 200, true) AS fresh FROM f),
    i AS (SELECT doc_id, start, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM r),
    s AS (SELECT doc_id, min(start) AS a, max(start) + 200 AS z FROM i GROUP BY doc_id, span),
    k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS free FROM s),
    t AS (SELECT doc_id, string_agg(substr(digits, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) || substr(any_value(digits), 2 * max(z) + 1) AS kept, sum(z - a) AS gone, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (length(digits) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, digits))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

_WINDOW_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
    r AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER ahead AS run, count(*) OVER ahead AS size FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    f AS (SELECT doc_id, i, word, size = 20 AND row_number() OVER (PARTITION BY run, size ORDER BY doc_id, i) > 1 AS again FROM r),
    g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
    k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_RESAMPLE_SQL = r"""WITH c AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step FROM range(256) r(i)),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
    w AS (SELECT doc_id, unnest(words) AS word FROM d),
    u AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INTEGER, 2))::BIGINT) AS bytes FROM (SELECT word FROM w UNION SELECT word FROM b)),
    k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM u, c),
    s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
    f AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
    a AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
    e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= 20 AS fit FROM a),
    r AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) END AS place FROM e)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) FILTER (fit) // 100 FROM e) THEN place END AS rank FROM r"""

_SEARCH_SQL = r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
    t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM s),
    m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM s, t),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, t),
    r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
    o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50"""

#: For pages whose article is one element with headings and paragraphs, as the given tables' are; the rules for other pages are tested by themselves.
_HTML_SQL = r"""WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
    b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS parts FROM a)
    SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)))::BIGINT AS n_chars FROM b"""

#: DuckDB SQL of the queries that SQL can express. Bytes are compared as digits, cut into stretches first, and counted by their md5.
ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": _SUFFIX_SQL, "op8_window_dedup": _WINDOW_SQL, "op11_importance_resampling": _RESAMPLE_SQL, "op12_ranked_search": _SEARCH_SQL, "op13_html_extraction": _HTML_SQL}
