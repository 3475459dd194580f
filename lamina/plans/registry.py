"""Named queries over the driver's tables, and DuckDB SQL with the same results.

Each pair is over whole tables. SQL macros keep the pieces that several share.
Doubles are compared at six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.config import ChunkerConfig
from lamina.functions import language, segment, text
from lamina.functions.segment import ABBREVIATIONS
from lamina.functions.text import BLANK, CONTROL, FLAGS_AR, FLAGS_EN, LINES, TASHKEEL, WS
from lamina.operators import chunking, corpus, metrics, spec, vectors
from lamina.operators.providers import HashEmbedder
from lamina.plans import fixtures
from lamina.sources.readers import html_text, read_html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs_sql(select: str, more: str = "") -> str:
    return f"WITH {fixtures.SQL}{', ' + more if more else ''} {select}"


docs = fixtures.docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL forms of the text functions.


def s_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def s_spaces(x: str) -> str:
    return f"regexp_replace({x}, '[{BLANK}]+', ' ', 'g')"


def s_newlines(x: str) -> str:
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def s_clean(x: str) -> str:
    return s_strip(s_newlines(s_spaces(x)))


def s_normal(x: str) -> str:
    return s_clean(f"regexp_replace(nfc_normalize({x}), '{CONTROL}', '', 'g')")


def s_count(x: str, kind: str) -> str:
    return f"length(regexp_replace({x}, '[^{kind}]+', '', 'g'))"


def s_language(x: str) -> str:
    a, n = s_count(x, language.ARABIC), s_count(x, "a-zA-Z")
    return (
        f"(CASE WHEN {a} + {n} = 0 THEN 'unknown' WHEN {a} / ({a} + {n}) >= 0.6 THEN 'ar' WHEN {n} / ({a} + {n}) >= 0.6 THEN 'en' "
        f"WHEN {a} > 0 AND {n} > 0 THEN 'mixed' ELSE 'unknown' END)"
    )


def s_script(x: str) -> str:
    a, n = s_count(x, language.ARABIC), s_count(x, "a-zA-Z")
    return f"(CASE WHEN {a} + {n} = 0 THEN 'mixed' WHEN {a} / ({a} + {n}) > 0.7 THEN 'arabic' WHEN {a} / ({a} + {n}) < 0.3 THEN 'latin' ELSE 'mixed' END)"


def s_arabic(x: str, yeh: bool = False, teh: bool = False) -> str:
    of, to = "آأإٱ٪٫٬،" + "ى" * yeh + "ة" * teh, "اااا%.,," + "ي" * yeh + "ه" * teh
    return s_clean(f"translate(replace(regexp_replace({x}, '{TASHKEEL}', '', 'g'), 'ـ', ''), '{of}', '{to}')")


def s_parts(x: str, marks: str) -> str:
    """Stripped non-empty parts after any of ``marks`` and white space, as a list."""
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([{marks}])[{WS}]+', '\\1' || chr(57344), 'g'), chr(57344)), lambda s: {s_strip('s')}), lambda s: s <> '')"


def s_paragraphs(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '\\n[{WS}]*\\n', chr(57344), 'g'), chr(57344)), lambda s: {s_strip('s')}), lambda s: s <> '')"


def s_sentences_arabic(x: str) -> str:
    return f"flatten(list_transform({s_paragraphs(x)}, lambda p: {s_parts('p', '.!؟؛')}))"


def s_english(x: str) -> str:
    for a in ABBREVIATIONS:
        x = f"regexp_replace({x}, '(?i){a.replace('.', chr(92) + '.')}', '{a.replace('.', '')}' || chr(57345), 'g')" if a.count(".") == 1 else (
            f"regexp_replace({x}, '(?i){a.replace('.', chr(92) + '.')}', '{a[0]}' || chr(57345) || '{a[2]}' || chr(57345), 'g')"
        )
    cut = f"""regexp_replace({x}, '([.!?])["'')\\]]*[{WS}]+([A-Z"''(\\[])', '\\1' || chr(57344) || '\\2', 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(57344)), lambda s: {s_strip('replace(s, chr(57345), chr(46))')}), lambda s: s <> '')"


def s_size(x: str) -> str:
    return f"greatest(1, length({x}) // 3)"


def s_rows(expression: str, source: str = "docs") -> str:
    """(doc_id, i, s) of a list."""
    return f"SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, {expression} AS l FROM {source})"


def rows_of(df: DataFrame, parts) -> DataFrame:
    # For an inner explode Spark would first filter by the size of the parts, and so make them several times.
    rows = df.select("doc_id", F.posexplode_outer(parts).alias("i", "s")).filter(F.col("i").isNotNull())
    return rows.withColumn("i", F.col("i").cast("long"))


# Normalization.


@query(docs_sql(f"SELECT doc_id, {s_normal('text')} AS text FROM docs"))
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query(docs_sql(f"SELECT doc_id, nfc_normalize(text) AS nfc, regexp_replace(text, '{CONTROL}', '', 'g') AS control, {s_spaces('text')} AS spaces, {s_newlines('text')} AS newlines, {s_strip('text')} AS stripped FROM docs"))
def normalize_steps(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id", text.unicode_form(t).alias("nfc"), text.strip_control(t).alias("control"), text.collapse_spaces(t).alias("spaces"),
        text.cap_newlines(t).alias("newlines"), text.strip(t).alias("stripped"),
    )


@query(docs_sql(f"SELECT doc_id, {s_clean('text')} AS text FROM docs"))
def clean_whitespace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clean_whitespace(F.col("text")).alias("text"))


@query(docs_sql(f"SELECT doc_id, {s_arabic('text')} AS text, {s_arabic('text', True, True)} AS folded FROM docs"))
def arabic_normalize(spark, sf_dir):
    more = ChunkerConfig(arabic_normalize_yeh=True, arabic_normalize_teh_marbuta=True)
    return docs(spark, sf_dir).select("doc_id", text.normalize_arabic(F.col("text")).alias("text"), text.normalize_arabic(F.col("text"), more).alias("folded"))


# Language.


@query(docs_sql(f"SELECT doc_id, {s_language('text')} AS language FROM docs"))
def detect_language(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", language.detect_language(F.col("text")).alias("language"))


@query(
    docs_sql(
        f"SELECT doc_id, {s_script('text')} AS script, coalesce({s_count('text', chr(92) + 'x{600}-' + chr(92) + 'x{6FF}')} / nullif(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')), 0) > 0.5, false) AS is_arabic, "
        f"len(list_filter(string_split(regexp_replace(text, '[{WS}]+', ' ', 'g'), ' '), lambda w: w <> ''))::INTEGER AS words FROM docs"
    )
)
def detect_script(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", language.detect_script(t).alias("script"), language.is_arabic(t).alias("is_arabic"), text.count_words(t).alias("words"))


@query(
    docs_sql(
        f"SELECT doc_id, i, s AS sentence, {s_language('s')} AS language FROM r", f"r AS ({s_rows(s_parts('text', '.!?؟'))})"
    )
)
def detect_segments(spark, sf_dir):
    # Row by row, where the language is compiled; inside a transform() it would be interpreted.
    found = rows_of(docs(spark, sf_dir), segment.sentences_fast(F.col("text")))
    return found.select("doc_id", "i", F.col("s").alias("sentence"), language.detect_language(F.col("s")).alias("language"))


def _runs_sql(source: str) -> str:
    return f"""
    p AS (SELECT doc, pos, language, row_number() OVER w - 1 AS i, lag(language) OVER w AS b FROM {source} WINDOW w AS (PARTITION BY doc ORDER BY pos)),
    g AS (SELECT *, sum(CASE WHEN i > 0 AND b IS NOT DISTINCT FROM language THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS run FROM p)
    SELECT doc, min(i) AS "start", max(i) + 1 AS "end", language FROM g GROUP BY doc, run, language"""


@query(f"WITH s AS (SELECT conv_id AS doc, turn AS pos, {s_language('text')} AS language FROM conversations), {_runs_sql('s')}")
def language_boundaries(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), language.detect_language(F.col("text")).alias("language"))
    return corpus.language_boundaries(turns, "doc", "pos")


@query(docs_sql(_runs_sql("x").strip(), f"r AS ({s_rows(s_parts('text', '.!?؟'))}), x AS (SELECT doc_id AS doc, i AS pos, {s_language('s')} AS language FROM r)").replace(") p AS (", "), p AS (", 1))
def language_runs(spark, sf_dir):
    found = rows_of(docs(spark, sf_dir), segment.sentences_fast(F.col("text")))
    return corpus.language_boundaries(found.select(F.col("doc_id").alias("doc"), F.col("i").alias("pos"), language.detect_language(F.col("s")).alias("language")), "doc", "pos")


# Sizes, hashes, small functions.


@query(
    docs_sql(
        f"SELECT doc_id, (CASE WHEN length(text) = 0 THEN 0 WHEN {s_language('text')} = 'ar' THEN greatest(1, length(text) * 2 // 5) ELSE greatest(1, length(text) // 3) END)::INTEGER AS tokens, "
        f"{s_size('text')}::INTEGER AS sizing, greatest(1, length(text) // 4)::INTEGER AS english, greatest(1, length(text) // 3)::INTEGER AS arabic, "
        f"(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, {s_count('text', '.!?؟')}) END)::INTEGER AS sentences FROM docs"
    )
)
def estimate_tokens(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id", text.estimate_tokens(t, language.detect_language(t)).alias("tokens"), text.sizing_tokens(t).alias("sizing"),
        text.rough_tokens(t).alias("english"), text.rough_tokens(t, 3).alias("arabic"), text.count_sentences(t).alias("sentences"),
    )


@query(docs_sql("SELECT doc_id, sha256(text) AS content_hash, md5('hash:' || text) AS embedding_key, md5(text) AS language_key FROM docs"))
def content_hash(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", text.content_hash(t).alias("content_hash"), text.cache_key(t, "hash").alias("embedding_key"), text.cache_key(t).alias("language_key"))


@query(docs_sql("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '...' END AS text FROM docs"))
def truncate_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.truncate_text(F.col("text")).alias("text"))


@query(
    docs_sql(
        f"SELECT doc_id, CASE WHEN length(text) <= n THEN text WHEN regexp_matches(e, '[.!?؟][{WS}]') THEN {s_strip('substr(e, instr(m, chr(57344)) + 1)')} ELSE {s_strip('e')} END AS overlap "
        f"FROM (SELECT *, regexp_replace(e, '([.!?؟])[{WS}]', '\\1' || chr(57344)) AS m FROM (SELECT *, right(text, n) AS e FROM (SELECT *, CASE WHEN {s_language('text')} = 'ar' THEN 60 ELSE 80 END AS n FROM docs)))"
    )
)
def overlap_boundary(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", text.overlap_boundary(t, 20, language.detect_language(t)).alias("overlap"))


def _s_flags(flags: dict[str, str]) -> str:
    return ", ".join(f"regexp_matches(text, '(?m){p}') AS {k}" for k, p in flags.items())


@query(docs_sql(f"SELECT doc_id, {_s_flags(FLAGS_EN)} FROM docs"))
def structure_flags_en(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in text.structure_flags(F.col("text")).items()])


@query(docs_sql(f"SELECT doc_id, {_s_flags(FLAGS_AR)} FROM docs"))
def structure_flags_ar(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in text.structure_flags(F.col("text"), "ar").items()])


@query(
    docs_sql(
        "SELECT doc_id, i, CASE " + " ".join(f"WHEN regexp_matches({s_strip('s')}, '{p}') THEN '{k}'" for k, p in LINES) + " END AS element FROM r",
        f"r AS ({s_rows('string_split(text, chr(10))')})",
    )
)
def line_elements(spark, sf_dir):
    found = rows_of(docs(spark, sf_dir), F.split("text", "\n", -1))
    return found.select("doc_id", "i", text.line_element(F.col("s")).alias("element"))


# Segmentation.


@query(docs_sql(s_rows(s_parts("text", ".!?؟"))))
def sentences_fast(spark, sf_dir):
    return rows_of(docs(spark, sf_dir), segment.sentences_fast(F.col("text")))


@query(docs_sql(s_rows(s_parts("text", ".!?؟؛"))))
def sentences_structure(spark, sf_dir):
    return rows_of(docs(spark, sf_dir), segment.sentences_wider(F.col("text")))


@query(docs_sql(s_rows(s_english("text"))))
def sentences_english(spark, sf_dir):
    return chunking.split_rows(docs(spark, sf_dir), segment.english)


@query(docs_sql(s_rows(s_sentences_arabic(s_arabic("text")))))
def sentences_arabic(spark, sf_dir):
    return rows_of(docs(spark, sf_dir), segment.sentences_arabic(text.normalize_arabic(F.col("text"))))


@query(docs_sql(s_rows(s_paragraphs("text"))))
def paragraphs(spark, sf_dir):
    return rows_of(docs(spark, sf_dir), segment.split_paragraphs(F.col("text")))


@query(
    docs_sql(
        "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, k) - 1 AS i, s FROM u",
        f"n AS (SELECT doc_id, {s_normal('text')} AS text FROM docs), d AS (SELECT *, {s_language('text')} AS l FROM n), "
        f"ln AS (SELECT doc_id, i AS j, {s_strip('s')} AS text, {s_language(s_strip('s'))} AS l FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS s FROM "
        "(SELECT doc_id, string_split(text, chr(10)) AS x FROM d WHERE l = 'mixed')) UNION ALL SELECT doc_id, 0, text, l FROM d WHERE l <> 'mixed'), "
        f"u AS (SELECT doc_id, j, unnest(range(len(x))) AS k, unnest(x) AS s FROM (SELECT doc_id, j, CASE WHEN l = 'ar' THEN {s_sentences_arabic(s_arabic('text'))} ELSE {s_english('text')} END AS x FROM ln))",
    )
)
def sentences_routed(spark, sf_dir):
    config = ChunkerConfig()
    return _fold_rows(spark, sf_dir, lambda t: segment.segment(t, segment.language(t), config))


# Packing and strategies.

_SMALL = ChunkerConfig(strategy="sentence")
_OVER = ChunkerConfig(strategy="sentence", chunk_overlap=40)


def s_pack(x: str, c: ChunkerConfig) -> str:
    """list_reduce over sentences: done chunks, the open one, its tokens."""
    init = "{'o': []::VARCHAR[], 'h': '', 'n': 0::BIGINT}"
    size = s_size("x.h")
    flush = "CASE WHEN a.n > 0 THEN list_append(a.o, a.h) ELSE a.o END"
    step = (
        f"CASE WHEN {size} > {c.max_chunk_size} THEN {{'o': list_append({flush}, x.h), 'h': '', 'n': 0::BIGINT}} "
        f"WHEN a.n + {size} > {c.chunk_size} THEN {{'o': {flush}, 'h': x.h, 'n': {size}}} "
        f"ELSE {{'o': a.o, 'h': CASE WHEN a.n > 0 THEN a.h || ' ' || x.h ELSE x.h END, 'n': a.n + {size}}} END"
    )
    return _s_fold(x, init, step, "CASE WHEN r.n > 0 THEN list_append(r.o, r.h) ELSE r.o END")


def _s_fold(x: str, init: str, step: str, end: str) -> str:
    # Elements become structs of the state's type, as the fold needs one type.
    items = f"list_prepend({init}, list_transform({x}, lambda t: {{'o': []::VARCHAR[], 'h': t, 'n': 0::BIGINT}}))"
    return f"list_transform([list_reduce({items}, lambda a, x: {step})], lambda r: {end})[1]"


def s_merge(x: str, c: ChunkerConfig) -> str:
    wide = "CASE WHEN a.n > 0 THEN a.h || ' ' || x.h ELSE x.h END"
    step = f"CASE WHEN {s_size('(' + wide + ')')} >= {c.min_chunk_size} THEN {{'o': list_append(a.o, {wide}), 'h': '', 'n': 0::BIGINT}} ELSE {{'o': a.o, 'h': {wide}, 'n': 1::BIGINT}} END"
    end = "CASE WHEN r.n = 0 THEN r.o WHEN len(r.o) = 0 THEN [r.h] ELSE list_append(r.o[:-2], r.o[-1] || ' ' || r.h) END"
    return _s_fold(x, "{'o': []::VARCHAR[], 'h': '', 'n': 0::BIGINT}", step, end)


def s_repack(x: str, c: ChunkerConfig) -> str:
    wide = "CASE WHEN a.n > 0 THEN a.h || ' ' || x.h ELSE x.h END"
    step = f"CASE WHEN {s_size('(' + wide + ')')} > {c.max_chunk_size} THEN {{'o': CASE WHEN a.n > 0 THEN list_append(a.o, a.h) ELSE a.o END, 'h': x.h, 'n': 1::BIGINT}} ELSE {{'o': a.o, 'h': {wide}, 'n': 1::BIGINT}} END"
    return _s_fold(x, "{'o': []::VARCHAR[], 'h': '', 'n': 0::BIGINT}", step, "CASE WHEN r.n > 0 THEN list_append(r.o, r.h) ELSE r.o END")


def s_split(x: str, c: ChunkerConfig) -> str:
    return f"flatten(list_transform({x}, lambda c: CASE WHEN {s_size('c')} <= {c.max_chunk_size} THEN [c] ELSE {s_repack(s_parts('c', '.!?؟'), c)} END))"


def _fold_rows(spark, sf_dir, f) -> DataFrame:
    return chunking.split_rows(docs(spark, sf_dir), lambda t: f(text.normalized(t)))


_N = f"n AS (SELECT doc_id, {s_normal('text')} AS text FROM docs), s AS (SELECT doc_id, {s_parts('text', '.!?؟')} AS l FROM n)"


@query(docs_sql(s_rows(s_pack("l", _SMALL), "s"), _N))
def pack_sentences(spark, sf_dir):
    return _fold_rows(spark, sf_dir, lambda t: spec.pack_sentences(segment.fast(t), _SMALL))


@query(docs_sql(s_rows(s_merge("l", _SMALL), "s"), _N))
def merge_small(spark, sf_dir):
    return _fold_rows(spark, sf_dir, lambda t: spec.merge_small(segment.fast(t), _SMALL.min_chunk_size))


@query(docs_sql(s_rows(s_split("[text]", _SMALL), "(SELECT * FROM n WHERE text <> '')"), _N))
def split_oversized(spark, sf_dir):
    return _fold_rows(spark, sf_dir, lambda t: spec.split_oversized([t] if t else [], _SMALL.max_chunk_size))


_TEXT_ONLY = ["document_id", "chunk_index", "total_chunks", "text"]
_CHUNKS = f"""n AS (SELECT doc_id, {s_normal('text')} AS text FROM docs), d AS (SELECT *, {s_language('text')} AS l FROM n),
ln AS (SELECT doc_id, i AS j, {s_strip('s')} AS text, {s_language(s_strip('s'))} AS l FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS s FROM
  (SELECT doc_id, string_split(text, chr(10)) AS x FROM d WHERE l = 'mixed')) UNION ALL SELECT doc_id, 0, text, l FROM d WHERE l <> 'mixed'),
u AS (SELECT doc_id, j, CASE WHEN l = 'ar' THEN {s_sentences_arabic(s_arabic('text'))} ELSE {s_english('text')} END AS x FROM ln),
se AS (SELECT doc_id, flatten(list(x ORDER BY j)) AS l FROM u GROUP BY doc_id),
pk AS (SELECT doc_id, {s_pack('l', _SMALL)} AS l FROM se), mg AS (SELECT doc_id, {s_merge('l', _SMALL)} AS l FROM pk), sp AS (SELECT doc_id, {s_split('l', _SMALL)} AS l FROM mg),
ch AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS i, len(l)::INTEGER AS n, unnest(l) AS s FROM sp)"""


@query(docs_sql("SELECT doc_id::VARCHAR AS document_id, i AS chunk_index, n AS total_chunks, s AS text FROM ch", _CHUNKS))
def chunk_sentence(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir), _SMALL).select(*_TEXT_ONLY)


_TAIL = f"""list_reduce(list_prepend({{'k': '', 'u': 0::BIGINT, 'go': true}}, list_transform(list_reverse({s_parts('p', '.!?؟')}), lambda t: {{'k': t, 'u': 0::BIGINT, 'go': true}})),
lambda a, x: CASE WHEN a.go AND a.u + {s_size('x.k')} <= {_OVER.chunk_overlap} THEN {{'k': CASE WHEN a.k = '' THEN x.k ELSE x.k || ' ' || a.k END, 'u': a.u + {s_size('x.k')}, 'go': true}} ELSE {{'k': a.k, 'u': a.u, 'go': false}} END).k"""


@query(
    docs_sql(
        f"SELECT doc_id::VARCHAR AS document_id, i AS chunk_index, n AS total_chunks, CASE WHEN coalesce(e, '') = '' THEN s ELSE e || ' ' || s END AS text FROM (SELECT *, CASE WHEN p IS NULL THEN '' ELSE {_TAIL} END AS e FROM "
        "(SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ch))",
        _CHUNKS,
    )
)
def chunk_sentence_overlap(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir), _OVER).select(*_TEXT_ONLY)


_META = f"""SELECT doc_id::VARCHAR AS document_id, i AS chunk_index, {s_language('s')} AS language, greatest(1, CASE WHEN coalesce(nullif({s_language('s')}, 'unknown'), dl) = 'ar' THEN length(s) * 2 // 5 ELSE length(s) // 3 END)::INTEGER AS token_count,
length(s)::INTEGER AS char_count, greatest(1, {s_count('s', '.!?؟')})::INTEGER AS sentence_count, CASE WHEN {s_language('s')} = 'ar' THEN {s_script('s')} ELSE 'latin' END AS script, sha256(s) AS content_hash,
sha256(doc_id::VARCHAR || chr(31) || 'sentence' || chr(31) || i::VARCHAR || chr(31) || s) AS chunk_id,
{', '.join(f"CASE WHEN {s_language('s')} = 'ar' THEN regexp_matches(s, '(?m){FLAGS_AR[k]}') ELSE regexp_matches(s, '(?m){FLAGS_EN[k]}') END AS {c}" for k, c in (('has_headers', 'contains_header'), ('has_tables', 'contains_table'), ('has_code', 'contains_code'), ('has_lists', 'contains_list')))}
FROM ch JOIN (SELECT doc_id, l AS dl FROM d) USING (doc_id)"""
_META_COLUMNS = "document_id chunk_index language token_count char_count sentence_count script content_hash chunk_id contains_header contains_table contains_code contains_list".split()


@query(docs_sql(_META, _CHUNKS))
def chunk_metadata(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir), _SMALL).select(*_META_COLUMNS)


@query(
    docs_sql(
        "SELECT doc_id::VARCHAR AS document_id, (k - 1)::INTEGER AS chunk_index, st::INTEGER AS start_char, (st + length(s))::INTEGER AS end_char FROM w WHERE k > 0",
        "RECURSIVE_MARK",
    ).replace(
        "RECURSIVE_MARK",
        _CHUNKS
        + ", w AS (SELECT doc_id, 0 AS k, -1::BIGINT AS st, '' AS s FROM (SELECT DISTINCT doc_id FROM ch) UNION ALL "
        "SELECT w.doc_id, w.k + 1, CASE WHEN instr(substr(n.text, w.st + 2), substr(ch.s, 1, 50)) > 0 THEN w.st + instr(substr(n.text, w.st + 2), substr(ch.s, 1, 50)) ELSE w.st + 1 END, ch.s "
        "FROM w JOIN ch ON ch.doc_id = w.doc_id AND ch.i = w.k JOIN n ON n.doc_id = w.doc_id)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def chunk_offsets(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir), _SMALL).select("document_id", "chunk_index", "start_char", "end_char")


_FIXED = ChunkerConfig(strategy="fixed", chunk_size=220, chunk_overlap=20)


def _s_rfind(start: str) -> str:
    """0-based end of the window that begins at ``start``: the last space near it, else its full length."""
    end, low = f"({start} + 880)", f"greatest({start} + 830, {start})"
    near = f"substr(text, {low} + 1, {end} + 50 - {low})"
    at = f"({low} + length({near}) - instr(reverse({near}), ' '))"
    return f"CASE WHEN {end} < length(text) AND instr(reverse({near}), ' ') > 0 AND {at} > {start} THEN {at} ELSE {end} END"


@query(
    "WITH RECURSIVE " + fixtures.SQL + f""", n AS (SELECT doc_id, {s_normal('text')} AS text FROM docs),
    w AS (SELECT doc_id, text, 0::BIGINT AS st, ({_s_rfind('0')})::BIGINT AS en FROM n WHERE text <> ''
      UNION ALL SELECT doc_id, text, st2, ({_s_rfind('st2')})::BIGINT FROM (SELECT doc_id, text, CASE WHEN en - 80 <= st THEN en ELSE en - 80 END AS st2 FROM w) WHERE st2 < length(text)),
    c AS (SELECT doc_id, st, {s_strip('substr(text, st + 1, en - st)')} AS s FROM w)
    SELECT doc_id::VARCHAR AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1)::INTEGER AS chunk_index, s AS text FROM c WHERE s <> ''"""
)
def chunk_fixed(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir), _FIXED).select("document_id", "chunk_index", "text")


def _plain(name: str, **more) -> Query:
    def run(spark, sf_dir):
        return chunking.chunk(docs(spark, sf_dir), ChunkerConfig(strategy=name, **more)).drop("custom")

    run.__name__ = f"chunk_{name}"
    return run


for _name in ("recursive", "hierarchical", "structure_aware"):
    query()(_plain(_name))


@query()
def chunk_semantic(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir), ChunkerConfig(strategy="semantic"), provider=HashEmbedder()).drop("custom")


@query()
def chunk_agentic(spark, sf_dir):
    """The language model's place is taken by one that answers a chunk a paragraph."""
    config = ChunkerConfig(strategy="agentic", openai_api_key="none")
    return chunking.chunk(docs(spark, sf_dir), config, ask=_paragraph_model).drop("custom")


def _paragraph_model(doc: str, config: ChunkerConfig) -> str:
    import json

    return json.dumps([{"text": p, "topic": p[:20]} for p in doc.split("\n") if p.strip()])


@query(docs_sql("SELECT doc_id::VARCHAR AS document_id, '' AS source_file, d.l AS language, length(d.text)::INTEGER AS total_chars, coalesce(len(se.l), 0)::INTEGER AS total_sentences, "
                "coalesce(list_sum(list_transform(se.l, lambda s: CASE WHEN d.l = 'ar' THEN greatest(1, length(s) * 2 // 5) ELSE greatest(1, length(s) // 3) END)), 0)::INTEGER AS total_tokens FROM d JOIN se USING (doc_id)", _CHUNKS))  # fmt: skip
def document_info(spark, sf_dir):
    return chunking.document_info(docs(spark, sf_dir), _SMALL)


# Structure.


def _structs(f, shape):
    from pyspark.sql import types as T

    fields = T.StructType([T.StructField(*x) for x in shape])

    @F.pandas_udf(T.ArrayType(fields))
    def run(t):
        import pandas as pd

        return pd.Series([f(x) for x in t], dtype=object)

    return run


@query()
def document_nodes(spark, sf_dir):
    from pyspark.sql import types as T

    s, i = T.StringType(), T.IntegerType()
    shape = [("kind", s), ("content", s), ("start", i), ("end", i), ("level", i), ("title", s), ("code", s), ("items", T.ArrayType(s)), ("rows", T.ArrayType(T.ArrayType(s)))]
    run = _structs(lambda t: [{k: getattr(n, k) for k, _ in shape} for n in spec.parse(t)], shape)
    return docs(spark, sf_dir).select("doc_id", F.posexplode(run("text")).alias("i", "n")).select("doc_id", "i", "n.*")


@query()
def document_sections(spark, sf_dir):
    from pyspark.sql import types as T

    s, i = T.StringType(), T.IntegerType()
    shape = [("heading", s), ("title", s), ("level", i), ("path", T.ArrayType(s)), ("start", i), ("end", i), ("text", s)]
    run = _structs(lambda t: [{k: getattr(n, k) for k, _ in shape} for n in spec.sections(spec.parse(t))], shape)
    return docs(spark, sf_dir).select("doc_id", F.posexplode(run("text")).alias("i", "n")).select("doc_id", "i", "n.*")


_BLOCK_LINES = f"""r AS ({s_rows('string_split(text, chr(10))')}), k AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(b, '{p}') THEN '{k}'" for k, p in (
    ('header', f'^#{{1,6}}[{WS}]+'), ('table', '^[|].*[|]$'), ('list', f'^[-*+•][{WS}]+|^[0-9]+[.)][{WS}]+'), ('code', '^(```|~~~)')))} ELSE 'text' END AS k
  FROM (SELECT *, {s_strip('s')} AS b FROM r)),
f AS (SELECT *, sum((k = 'code')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM k),
e AS (SELECT *, CASE WHEN inside OR k = 'code' THEN 'code' ELSE k END AS e, k = 'code' AND NOT inside AS closes, k = 'code' AND inside AS opens FROM f),
p AS (SELECT *, sum((opens OR e = 'header' OR coalesce(pc OR pe = 'header' OR pe <> e, true))::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS block
  FROM (SELECT *, lag(e) OVER w AS pe, lag(closes) OVER w AS pc FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i))),
bl AS (SELECT doc_id, block, any_value(e) AS type, string_agg(s, chr(10) ORDER BY i) AS content FROM p GROUP BY doc_id, block)"""


@query(docs_sql(f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INTEGER AS i, type, content FROM bl WHERE regexp_matches(content, '[^{WS}]')", _BLOCK_LINES))
def split_blocks(spark, sf_dir):
    from pyspark.sql import types as T

    run = _structs(lambda t: [{"type": k, "content": c} for k, c in spec.blocks(t)], [("type", T.StringType()), ("content", T.StringType())])
    return docs(spark, sf_dir).select("doc_id", F.posexplode(run("text")).alias("i", "b")).select("doc_id", "i", "b.*")


@query(
    docs_sql(
        "SELECT doc_id, title, level, content FROM (SELECT doc_id, h, max(CASE WHEN k THEN regexp_extract(s, '^(#{1,6})[ws]+(.+)$', 2) END) AS t, coalesce(STRIP, '') AS title, coalesce(length(max(CASE WHEN k THEN regexp_extract(s, '^(#{1,6})[ws]', 1) END)), 0)::INTEGER AS level, "
        "coalesce(string_agg(s || chr(10), '' ORDER BY i) FILTER (NOT k), '') AS content FROM h GROUP BY doc_id, h) WHERE regexp_matches(content, '[^ws]')",
        f"r AS ({s_rows('string_split(text, chr(10))')}), m AS (SELECT *, regexp_matches(s, '^#{{1,6}}[ws]+.+$') AS k FROM r), h AS (SELECT *, sum(k::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM m)",
    )
    .replace("STRIP", s_strip("max(CASE WHEN k THEN regexp_extract(s, '^(#{1,6})[ws]+(.+)$', 2) END)"))
    .replace("[ws]", f"[{WS}]")
    .replace("[^ws]", f"[^{WS}]")
)
def extract_sections(spark, sf_dir):
    from pyspark.sql import types as T

    s = T.StringType()
    run = _structs(lambda t: [{"title": a, "level": b, "content": c} for a, b, c in spec.titled_sections(t)], [("title", s), ("level", T.IntegerType()), ("content", s)])
    return docs(spark, sf_dir).select("doc_id", F.explode(run("text")).alias("x")).select("doc_id", "x.*")


# Pages and conversations.


@query()
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", html_text(F.col("html")).alias("text"))


@query()
def html_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_file"), "html")
    return chunking.chunk(pages, document_id="page_id", column="html", read=read_html).drop("custom")


@query()
def conversation_chunks(spark, sf_dir):
    """Turns as sections under their speaker, chunked by structure."""
    turns = table(spark, sf_dir, "conversations")
    whole = turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n"), t["text"])), "\n\n").alias("text")
    )
    return chunking.chunk(whole, document_id="conv_id").drop("custom")


# Deduplication and statistics.


_FIRST_IN = "SELECT doc_id::VARCHAR AS document_id, i AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY {by}sha256(s) ORDER BY {order}i) AS r FROM ch) WHERE r = 1"


@query(docs_sql(_FIRST_IN.format(by="doc_id, ", order=""), _CHUNKS))
def dedup_within(spark, sf_dir):
    return corpus.deduplicate(chunking.chunk(docs(spark, sf_dir), _SMALL)).select("document_id", "chunk_index")


@query(docs_sql(_FIRST_IN.format(by="", order="doc_id, "), _CHUNKS))
def dedup_batch(spark, sf_dir):
    chunks = chunking.chunk(docs(spark, sf_dir), _SMALL).withColumn("order", F.col("document_id").cast("long"))
    return corpus.deduplicate_batch(chunks, "order").select("document_id", "chunk_index")


@query(docs_sql(f"SELECT d.doc_id, count(k.document_id) AS chunks FROM docs d LEFT JOIN ({_FIRST_IN.format(by='', order='doc_id, ')}) k ON k.document_id = d.doc_id::VARCHAR GROUP BY d.doc_id", _CHUNKS))
def dedup_batch_counts(spark, sf_dir):
    d = docs(spark, sf_dir)
    chunks = chunking.chunk(d, _SMALL).withColumn("order", F.col("document_id").cast("long"))
    return corpus.batch_with_empties(d, corpus.deduplicate_batch(chunks, "order"), "doc_id")


@query(docs_sql('SELECT count(*) AS total, count(DISTINCT sha256(s)) AS "unique", count(*) - count(DISTINCT sha256(s)) AS duplicates FROM ch', _CHUNKS))
def count_duplicates(spark, sf_dir):
    return corpus.count_duplicates(chunking.chunk(docs(spark, sf_dir), _SMALL))


def _s_stats(by: str) -> str:
    return f"""SELECT {by}, count(*) AS total_chunks, sum(token_count)::BIGINT AS total_tokens, sum(token_count) / count(*) AS avg_tokens_per_chunk, min(token_count) AS min_tokens, max(token_count) AS max_tokens,
    list_sort(list(token_count))[count(*) // 2 + 1] AS median_tokens FROM ({_META}) GROUP BY {by}"""


@query(docs_sql(_s_stats("language"), _CHUNKS))
def chunk_stats(spark, sf_dir):
    """Sizes of sentence chunks by language."""
    return corpus.chunk_stats(chunking.chunk(docs(spark, sf_dir), _SMALL), ["language"])


@query(docs_sql(_s_stats("document_id"), _CHUNKS))
def document_stats(spark, sf_dir):
    return corpus.chunk_stats(chunking.chunk(docs(spark, sf_dir), _SMALL))


@query(docs_sql(f"SELECT document_id, language, count(*) AS n FROM ({_META}) GROUP BY 1, 2", _CHUNKS))
def language_distribution(spark, sf_dir):
    found = corpus.language_distribution(chunking.chunk(docs(spark, sf_dir), _SMALL))
    return found.select("document_id", F.explode("language_distribution").alias("language", "n"))


_RUNS = f"SELECT document_id, arg_min(language, chunk_index) AS language, count(*) AS chunk_count, sum(token_count) AS token_count, (count(*) * 1.5)::DOUBLE AS duration_ms FROM ({_META}) GROUP BY 1"


def _runs(spark, sf_dir) -> DataFrame:
    """Runs of which each chunk took 1.5 ms."""
    found = metrics.runs_of(chunking.chunk(docs(spark, sf_dir), _SMALL))
    return found.withColumn("duration_ms", F.col("chunk_count") * F.lit(1.5))


@query(
    docs_sql(
        f"SELECT count(*) AS documents_processed, sum(chunk_count)::BIGINT AS total_chunks_created, sum(token_count)::BIGINT AS total_tokens_processed, sum(duration_ms) AS total_processing_time_ms, "
        f"avg(duration_ms) AS avg_processing_time_ms, min(duration_ms) AS min_processing_time_ms, max(duration_ms) AS max_processing_time_ms FROM ({_RUNS})",
        _CHUNKS,
    )
)
def metrics_summary(spark, sf_dir):
    return metrics.summary(_runs(spark, sf_dir))


@query(docs_sql(f"SELECT language, count(*) AS documents FROM ({_RUNS}) GROUP BY 1", _CHUNKS))
def metrics_languages(spark, sf_dir):
    return metrics.language_summary(_runs(spark, sf_dir))


# Vectors. label is the document, vec_id the position.

_UNITS = """e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT *, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS nv FROM e),
d AS (SELECT label, vec_id, CASE WHEN nv IS NULL THEN NULL ELSE 1 - list_cosine_similarity(v, nv) END AS distance FROM x)"""
_LIMITS = {
    "percentile": "quantile_cont(distance, 0.9)",
    "standard_deviation": "avg(distance) + 1.5 * stddev_pop(distance)",
    "interquartile": "quantile_cont(distance, 0.75) + 1.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25))",
}
_AMOUNTS = {"percentile": 90.0, "standard_deviation": 1.5, "interquartile": 1.5, "gradient": 0.1}
_GRADIENT = "g AS (SELECT label, coalesce((a - b) / 2, a - distance, distance - b) AS g FROM (SELECT *, lead(distance) OVER w AS a, lag(distance) OVER w AS b FROM d WHERE distance IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY vec_id)))"
_BREAKS = f"t AS (SELECT label, {_LIMITS['percentile']} AS t FROM d WHERE distance IS NOT NULL GROUP BY label), b AS (SELECT label, vec_id, coalesce(distance >= t, false) AS is_break FROM d LEFT JOIN t USING (label))"


def _distances(spark, sf_dir) -> DataFrame:
    return vectors.pairwise_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id").select("label", "vec_id", "distance")


@query(f"WITH {_UNITS} SELECT label, vec_id, round(distance, 6) AS distance FROM d")
def pairwise_distance(spark, sf_dir):
    return _distances(spark, sf_dir).withColumn("distance", F.round("distance", 6))


def _threshold(kind: str) -> Query:
    def run(spark, sf_dir):
        return vectors.thresholds(_distances(spark, sf_dir), "label", "vec_id", kind, _AMOUNTS[kind]).withColumn("threshold", F.round("threshold", 6))

    run.__name__ = f"threshold_{kind}"
    return run


for _kind, _limit in _LIMITS.items():
    query(f"WITH {_UNITS} SELECT label, round({_limit}, 6) AS threshold FROM d WHERE distance IS NOT NULL GROUP BY label")(_threshold(_kind))
query(f"WITH {_UNITS}, {_GRADIENT} SELECT label, round(avg(abs(g)) + 0.1, 6) AS threshold FROM g GROUP BY label")(_threshold("gradient"))


@query(f"WITH {_UNITS}, {_BREAKS} SELECT * FROM b")
def semantic_breakpoints(spark, sf_dir):
    return vectors.breakpoints(_distances(spark, sf_dir), "label", "vec_id").select("label", "vec_id", "is_break")


@query(
    f"WITH {_UNITS}, {_BREAKS}, s AS (SELECT *, coalesce(sum(is_break::INTEGER) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM b) "
    "SELECT label, segment::INTEGER AS segment, string_agg('v' || vec_id, ' ' ORDER BY vec_id) AS text FROM s GROUP BY 1, 2"
)
def semantic_segments(spark, sf_dir):
    broken = vectors.breakpoints(_distances(spark, sf_dir), "label", "vec_id")
    named = vectors.segments(broken, "label", "vec_id").withColumn("text", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    return vectors.segment_texts(named, "label", "vec_id")


@query(
    "WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label, a.n, round(CASE WHEN a.n = 1 THEN 1.0 ELSE b.s / (a.n * (a.n - 1)) END, 6) AS coherence FROM (SELECT label, count(*) AS n FROM e GROUP BY 1) a "
    "LEFT JOIN (SELECT x.label, sum(list_cosine_similarity(x.v, y.v)) AS s FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id GROUP BY 1) b USING (label)"
)
def coherence(spark, sf_dir):
    return vectors.coherence(table(spark, sf_dir, "embeddings"), "label").withColumn("coherence", F.round("coherence", 6))


_QUERY = [((i * 37) % 11 - 5) / 5 for i in range(64)]


@query(
    f"WITH q AS (SELECT {_QUERY}::DOUBLE[] AS q) SELECT vec_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE label <> 3) ORDER BY score DESC, vec_id LIMIT 5"
)
def cosine_topk(spark, sf_dir):
    """The five nearest to one vector, of those whose label isn't 3."""
    found = vectors.search(table(spark, sf_dir, "embeddings"), _QUERY, 5, "label <> 3")
    return found.select("vec_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query(
    "WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY 1), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5"
)
def cosine_topk_many(spark, sf_dir):
    """The five nearest to the first vector of each label."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return vectors.search_many(e, asked).withColumn("score", F.round("score", 6))


@query()
def embed_chunks(spark, sf_dir):
    """Sentence chunks with hashed embeddings, each distinct text embedded once."""
    return chunking.embed(chunking.chunk(docs(spark, sf_dir), _SMALL).select("chunk_id", "text"))


@query(
    docs_sql(
        "SELECT document_id, list_sort(list_distinct(list(language))) AS languages, count(*) AS total_chunks, sum(token_count)::BIGINT AS total_tokens, sum(token_count) / count(*) AS avg_tokens_per_chunk, "
        "min(token_count) AS min_tokens, max(token_count) AS max_tokens, list_sort(list(token_count))[count(*) // 2 + 1] AS median_tokens, 'sentence' AS strategy FROM me GROUP BY 1",
        f"{_CHUNKS}, me AS ({_META})",
    )
)
def stats_of_documents(spark, sf_dir):
    """All statistics of each document at once."""
    found = corpus.get_stats(chunking.chunk(docs(spark, sf_dir), _SMALL))
    return found.withColumn("languages", F.sort_array(F.map_keys("language_distribution"))).drop("language_distribution")


@query()
def chunk_json(spark, sf_dir):
    return chunking.to_dict(chunking.chunk(docs(spark, sf_dir), _SMALL))


@query(docs_sql("SELECT count(*) AS n, count(*) FILTER (json_valid(to_json(s))) AS ok FROM ch", _CHUNKS))
def chunk_json_counts(spark, sf_dir):
    j = chunking.to_dict(chunking.chunk(docs(spark, sf_dir), _SMALL))
    return j.agg(F.count("*").alias("n"), F.count(F.get_json_object("json", "$.metadata.chunk_id")).alias("ok"))
