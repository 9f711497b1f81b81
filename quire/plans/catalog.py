"""The registered queries of the document engine and their SQL twins, over the driver's tables.

`documents` are texts, `conversations` ordered chunks of a document (conv_id, turn), `pages` HTML files, `embeddings`
vectors of consecutive paragraphs, `customer` a table to profile, `events.props` JSON files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking, enrich, render, structure
from quire.operators import page_lines as lines_ops
from quire.session import prepare, spread, table
from quire.sources.read import parse_files

QUERIES = {}
SQL = {}

#: What the SQL twins share.
WORDS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"
N_WORDS = f"len({WORDS})"
STOPS = ", ".join(f"'{w}'" for w in enrich.STOP_WORDS)
SYLLABLES = r"""CASE WHEN len({p}) = 0 THEN 1.0 ELSE round(list_sum(list_transform({p}, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')))))::DOUBLE / len({p}), 2) END"""
PLAIN = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"


def n_words(t: str) -> str:
    return N_WORDS.format(t=t)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chunks of documents."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), "role")


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS (SELECT doc_id, {n_words('t')} AS w, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s, E' \\n\\t') <> '')) AS s, {PLAIN.format(t='t')} AS p FROM d),
    x AS (SELECT *, {SYLLABLES.format(p='p')} AS y FROM m)
    SELECT doc_id, w AS word_count, s AS sentence_count, CASE WHEN w = 0 OR s = 0 THEN 50.0 ELSE round(greatest(0.0, least(100.0, 206.835 - 1.015 * (w / s) - 84.6 * y)), 2) END AS complexity_score FROM x""")
def doc_readability(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.word_count("text").alias("word_count"), T.sentence_count("text").alias("sentence_count"), T.complexity_score("text").alias("complexity_score"))


@query(f"""WITH d AS (SELECT doc_id, {WORDS.format(t="coalesce(text, '')")} AS ws FROM documents)
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(list_sum(list_transform(ws, lambda w: length(trim(w, '.,!?;:')))) / len(ws), 2) END AS avg_word_length,
    CASE WHEN len(ws) / 200 < 1 THEN floor(len(ws) / 200 * 60)::BIGINT || ' sec' ELSE floor(len(ws) / 200)::BIGINT || ' min' END AS reading_time FROM d""")
def reading_time_avg_word_len(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.avg_word_length("text").alias("avg_word_length"), T.reading_time("text").alias("reading_time"))


@query(r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS ls FROM documents),
    m AS (SELECT doc_id, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM l),
    x AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM m)
    SELECT doc_id, line_no, line, CASE WHEN starts_with(trim(line), '```') THEN 'code_fence' WHEN regexp_matches(line, '^\s*[-*+]\s+') OR regexp_matches(line, '^\s*\d+\.\s+') THEN 'list_item'
    WHEN regexp_matches(line, '\[([^\]]+)\]\(([^)]+)\)') THEN 'link' WHEN regexp_matches(line, '!\[([^\]]*)\]\(([^)]+)\)') THEN 'image' WHEN starts_with(trim(line), '>') THEN 'blockquote' ELSE 'text' END AS kind FROM x""")
def line_classify(spark, sf_dir):
    return structure.lines(documents(spark, sf_dir))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n[ \t]*(\n[ \t]*)+'), lambda x: trim(x, E'\n')), lambda x: trim(x, E' \n') <> '') AS ps FROM documents)
    SELECT doc_id, generate_subscripts(ps, 1) - 1 AS para_no, unnest(ps) AS para FROM p""")
def paragraph_islands(spark, sf_dir):
    return structure.paragraphs(documents(spark, sf_dir))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \n')), lambda x: x <> '') AS ss FROM documents)
    SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sentence_no, unnest(ss) AS sentence FROM s""")
def sentence_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences("text")).alias("sentence_no", "sentence"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
    x AS (SELECT *, unnest(range(0, greatest(n, 1), 2000)) AS o FROM d)
    SELECT doc_id, o AS offset, substring(t, o + 1, 2000) AS page_text, least(o + 2000, n) - o AS returned_chars, n AS total_chars, n - least(o + 2000, n) AS remaining_chars, n > o + 2000 AS has_more FROM x""")
def page_windows(spark, sf_dir):
    return structure.windows(documents(spark, sf_dir), 2000)


@query("""SELECT doc_id, substring(t, 1, 5000) AS summary, CASE WHEN length(t) > 5000 THEN 5000 ELSE length(t) END AS continue_at, CASE WHEN length(t) > 500 THEN substring(t, 1, 500) || '...' ELSE t END AS text_preview, length(t) AS total_characters
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def summary_preview(spark, sf_dir):
    t = T.without_placeholders("text")
    d = documents(spark, sf_dir).select("doc_id", t.alias("t"))
    return d.select("doc_id", F.substring("t", 1, 5000).alias("summary"), F.least(F.length("t"), F.lit(5000)).alias("continue_at"), T.preview("t", 500).alias("text_preview"), F.length("t").alias("total_characters"))


def fixed_sql(target: int) -> str:
    """Lines, sentences of longer lines and word runs of longer sentences are units; they fill chunks greedily."""
    return rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents),
    s AS (SELECT doc_id, i, line, {n_words('line')} AS n FROM l WHERE trim(line) <> ''),
    u1 AS (SELECT doc_id, i, 0 AS j, trim(line) AS unit, n FROM s WHERE n <= {target}),
    q AS (SELECT doc_id, i, list_filter(list_transform(string_split(regexp_replace(line, '([.!?][")\x27\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM s WHERE n > {target}),
    u2 AS (SELECT doc_id, i, generate_subscripts(ss, 1) AS j, unnest(ss) AS sentence FROM q),
    u3 AS (SELECT doc_id, i, j, {WORDS.format(t='sentence')} AS ws FROM u2),
    u4 AS (SELECT doc_id, i, j * 100000 + k AS j, array_to_string(ws[k + 1:k + {target}], ' ') AS unit, len(ws[k + 1:k + {target}]) AS n FROM (SELECT *, unnest(range(0, len(ws), {target})) AS k FROM u3)),
    u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS r, n, length(unit) AS c FROM (SELECT * FROM u1 UNION ALL SELECT * FROM u4)),
    f AS (SELECT doc_id, r, n, c, 0 AS chunk_id, n AS filled FROM u WHERE r = 1
        UNION ALL SELECT u.doc_id, u.r, u.n, u.c, CASE WHEN f.filled + u.n > {target} THEN f.chunk_id + 1 ELSE f.chunk_id END, CASE WHEN f.filled + u.n > {target} THEN u.n ELSE f.filled + u.n END FROM f JOIN u ON u.doc_id = f.doc_id AND u.r = f.r + 1)
    SELECT doc_id, chunk_id, CAST(sum(n) AS BIGINT) AS words, CAST(sum(c) + count(*) - 1 AS BIGINT) AS chars_at_most FROM f GROUP BY doc_id, chunk_id"""


@query(fixed_sql(200).replace(", CAST(sum(c) + count(*) - 1 AS BIGINT) AS chars_at_most", ""))
def fixed_chunks(spark, sf_dir):
    return chunking.chunk(documents(spark, sf_dir), "fixed", 200, 0).select("doc_id", "chunk_id", F.col("word_count").cast("long").alias("words"))


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.chunk(documents(spark, sf_dir), "recursive", 200, 0)


@query()
def chunk_overlap_stats(spark, sf_dir):
    c = chunking.chunk(documents(spark, sf_dir), "recursive", 200, 40)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("word_count").alias("words"), F.max("word_count").alias("largest"))


@query(rf"""WITH l AS (SELECT conv_id AS doc_id, turn AS chunk_id, coalesce(text, '') AS text, trim(string_split(coalesce(text, ''), E'\n')[1]) AS line FROM conversations),
    h AS (SELECT *, {n_words('line')} AS n, {n_words('text')} AS tn FROM l),
    x AS (SELECT doc_id, chunk_id, tn, CASE WHEN tn < 5 OR line = '' OR n > 15 THEN NULL
        WHEN regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '\p{{Ll}}') AND n <= 10 THEN array_to_string(list_transform(range(1, length(line) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(line[i - 1], '\p{{L}}') THEN lower(line[i]) ELSE upper(line[i]) END), '') WHEN ends_with(line, ':') AND n <= 8 THEN left(line, length(line) - 1)
        WHEN regexp_matches(line, '^(\d+\.)+\s+(.+)') THEN regexp_extract(line, '^(\d+\.)+\s+(.+)', 2) WHEN regexp_matches(line, '^\*\*(.+?)\*\*') THEN regexp_extract(line, '^\*\*(.+?)\*\*', 1)
        WHEN regexp_matches(line, '^_(.+?)_') THEN regexp_extract(line, '^_(.+?)_', 1) END AS header FROM h)
    SELECT doc_id, chunk_id, CASE WHEN tn >= 5 THEN coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING), 'Section 1') END AS section_name FROM x""")
def section_header_detect(spark, sf_dir):
    c = enrich.with_sections(turns(spark, sf_dir), "doc_id", "chunk_id")
    return c.select("doc_id", "chunk_id", "section_name")


TILING = f"""WITH c AS (SELECT conv_id AS doc_id, turn AS chunk_id, list_distinct(list_filter({WORDS.format(t="lower(coalesce(text, ''))")}, lambda w: length(w) > 2)) AS bag FROM conversations),
    p AS (SELECT *, lag(bag) OVER w AS prev, count(*) OVER (PARTITION BY doc_id) AS n FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)),
    s AS (SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN len(bag) = 0 OR len(prev) = 0 THEN 0.0 ELSE len(list_intersect(bag, prev)) / (len(bag) + len(prev) - len(list_intersect(bag, prev))) END AS sim FROM p),
    v AS (SELECT *, coalesce(sim < lag(sim) OVER w AND sim < lead(sim) OVER w AND n >= 3, false) AS cut FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id))
    SELECT doc_id, chunk_id, 'Section ' || (sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) + 1)::BIGINT AS section_name FROM v"""


@query(TILING)
def texttiling_sections(spark, sf_dir):
    return enrich.with_topic_sections(turns(spark, sf_dir), "doc_id", "chunk_id").select("doc_id", "chunk_id", "section_name")


@query(rf"""WITH c AS (SELECT conv_id AS doc_id, turn AS chunk_id, trim(coalesce(text, ''), E' \n') AS t, {n_words("coalesce(text, '')")} AS n FROM conversations),
    s AS (SELECT *, trim(regexp_extract(t, '([^.!?]+[.!?]+)', 1), E' \n') AS sentence, trim(string_split(t, E'\n')[1]) AS line FROM c),
    x AS (SELECT doc_id, chunk_id, n, t, regexp_replace(CASE WHEN sentence <> '' THEN sentence ELSE line END, '[.!?:;,]+$', '') AS title FROM s)
    SELECT doc_id, chunk_id, CASE WHEN n < 5 THEN NULL WHEN length(title) > 80 THEN substring(title, 1, 77) || '...' ELSE title END AS section_name FROM x""")
def generated_titles(spark, sf_dir):
    c = turns(spark, sf_dir).withColumn("section_name", F.lit(None).cast("string"))
    return enrich.with_titles(c, "first_sentence").select("doc_id", "chunk_id", "section_name")


RAKE = rf"""WITH d AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[.!?;]') AS ss FROM documents),
    s AS (SELECT doc_id, generate_subscripts(ss, 1) AS si, list_filter(regexp_split_to_array(unnest(ss), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+')) AS ws FROM d),
    w AS (SELECT doc_id, si, generate_subscripts(ws, 1) AS wi, unnest(ws) AS word FROM s),
    b AS (SELECT *, (word IN ({STOPS}) OR length(word) < 3) AS stop FROM w),
    g AS (SELECT *, sum(stop::INT) OVER (PARTITION BY doc_id, si ORDER BY wi) AS isle FROM b),
    p AS (SELECT doc_id, si, isle, string_agg(word, ' ' ORDER BY wi) AS phrase, count(*) AS n, min(wi) AS wi FROM g WHERE NOT stop GROUP BY doc_id, si, isle),
    f AS (SELECT doc_id, word, sum(p.n - 1) / count(*) AS ratio FROM g JOIN p USING (doc_id, si, isle) WHERE NOT stop GROUP BY doc_id, word),
    u AS (SELECT doc_id, phrase, min(si * 1000000 + g0.wi) AS pos FROM p g0 GROUP BY doc_id, phrase),
    x AS (SELECT doc_id, phrase, pos, round(sum(ratio), 6) AS score, count(*) AS n FROM (SELECT doc_id, phrase, pos, unnest(string_split(phrase, ' ')) AS word FROM u) JOIN f USING (doc_id, word) GROUP BY doc_id, phrase, pos),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM x WHERE n <= 4)
    SELECT doc_id, rank, phrase, score FROM r WHERE rank <= 5"""


@query(RAKE)
def rake_keywords(spark, sf_dir):
    return enrich.rake(documents(spark, sf_dir))


@query(rf"""WITH t AS (SELECT conv_id AS doc_id, turn AS chunk_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_-]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9_-]+') AND w NOT IN ({STOPS})) AS w FROM conversations),
    e AS (SELECT doc_id, chunk_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
    tf AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM e GROUP BY ALL),
    df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
    n AS (SELECT conv_id AS doc_id, count(DISTINCT turn) AS n FROM conversations GROUP BY ALL),
    x AS (SELECT doc_id, chunk_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS weight FROM tf JOIN df USING (doc_id, term) JOIN n USING (doc_id))
    SELECT doc_id, chunk_id, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id, chunk_id)), 6) AS score FROM x""")
def tfidf_scores(spark, sf_dir):
    return enrich.term_scores(turns(spark, sf_dir), "doc_id", "chunk_id")


@query()
def tfidf_keywords(spark, sf_dir):
    return enrich.tfidf(turns(spark, sf_dir), "doc_id", "chunk_id")


DISTANCES = """WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    d AS (SELECT label, vec_id, 1 - list_cosine_similarity(b, e) AS distance FROM v WHERE b IS NOT NULL)"""


def breakpoint_query(name: str, method: str, limit: str) -> None:
    def run(spark, sf_dir):
        d = structure.adjacent_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
        return structure.breakpoints(d, "label", "vec_id", method).select("label", "vec_id", F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"))

    QUERIES[name] = run
    SQL[name] = f"{DISTANCES}, t AS (SELECT label, {limit} AS threshold FROM d GROUP BY label) SELECT label, vec_id, round(distance, 6) AS distance, round(threshold, 6) AS threshold FROM d JOIN t USING (label) WHERE distance > threshold"


breakpoint_query("semantic_breakpoints_percentile", "percentile", "quantile_cont(distance, 0.5)")
breakpoint_query("semantic_breakpoints_deviation", "standard_deviation", "avg(distance) + stddev_pop(distance)")
breakpoint_query("semantic_breakpoints_iqr", "interquartile", "quantile_cont(distance, 0.75) + 1.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25))")


def bands(spark, sf_dir):
    """First and last line of each document, as the bands of a page of its source."""
    ends = F.array_distinct(F.array(F.element_at(structure.text_lines("text"), 1), F.element_at(structure.text_lines("text"), -1)))
    return documents(spark, sf_dir).where("text <> ''").select("source", "doc_id", F.explode(ends).alias("line"))


KEY = r"lower(regexp_replace(trim(regexp_replace(regexp_replace(line, '[*_#`]+', '', 'g'), '\s+', ' ', 'g')), '\d+', '#', 'g'))"
BANDS = r"""WITH l AS (SELECT source, doc_id, string_split(text, E'\n') AS ls FROM documents WHERE text <> ''),
    m AS (SELECT source, doc_id, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM l),
    b AS (SELECT source, doc_id, unnest(list_distinct([ls[1], ls[len(ls)]])) AS line FROM m)"""


@query(f"""{BANDS}, k AS (SELECT source, {KEY} AS running_key, count(DISTINCT doc_id) AS n_pages FROM b GROUP BY ALL), t AS (SELECT source, count(DISTINCT doc_id) AS pages FROM b GROUP BY ALL)
    SELECT source, running_key, n_pages FROM k JOIN t USING (source) WHERE running_key <> '' AND n_pages >= greatest(3, floor(pages * 0.02))""")
def running_noise(spark, sf_dir):
    return structure.running_lines(bands(spark, sf_dir), "source", "doc_id", "line", share=0.02)


@query("SELECT sha1(coalesce(text, '')) AS digest, min(doc_id) AS first_id, count(DISTINCT source) AS n_places, count(*) AS n_records FROM documents GROUP BY ALL")
def exact_dup_groups(spark, sf_dir):
    return structure.duplicate_counts(documents(spark, sf_dir), "text", "doc_id", "source")


PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS v FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query(rf"""WITH x AS ({PROFILE}), y AS (SELECT "column", trim(coalesce(v, '')) AS v FROM x)
    SELECT "column", CASE WHEN coalesce(bool_and(regexp_full_match(nullif(v, ''), '[+-]?\d+')), false) THEN 'integer' WHEN coalesce(bool_and(regexp_full_match(nullif(v, ''), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')), false) THEN 'float'
    WHEN coalesce(bool_and(lower(nullif(v, '')) IN ('true', 'false')), false) THEN 'boolean' ELSE 'text' END AS type, count(*) FILTER (v = '') AS null_count, count(DISTINCT nullif(v, '')) AS unique_count FROM y GROUP BY "column" """)
def column_profile(spark, sf_dir):
    return structure.column_profile(table(spark, sf_dir, "customer"))


@query("SELECT event_id, 'object' AS root_type, len(json_keys(props)) AS total_keys, array_to_string(json_keys(props), ',') AS root_keys FROM events")
def json_structure(spark, sf_dir):
    got = structure.json_structure(table(spark, sf_dir, "events"), "event_id", "props")
    return got.withColumn("root_keys", F.array_join("root_keys", ","))


COMPACT_BLOCK = rf"""turn || '|0-' || length(coalesce(text, '')) || '|text|' || replace(replace(role, '|', '\|'), E'\n', ' ') || E'\n' || coalesce(text, '')"""


def named_turns(spark, sf_dir):
    return turns(spark, sf_dir).withColumn("section_name", F.col("role"))


@query(f"""SELECT conv_id AS doc_id, 'd:' || conv_id || '|t:unknown|w:' || sum({n_words("coalesce(text, '')")})::BIGINT || '|n:' || count(*) || E'\\n' || string_agg(E'---\\n' || {COMPACT_BLOCK}, E'\\n' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def compact_documents(spark, sf_dir):
    return render.compact_documents(named_turns(spark, sf_dir))


@query(f"SELECT conv_id AS doc_id, turn AS chunk_id, {COMPACT_BLOCK} AS block FROM conversations")
def compact_chunks(spark, sf_dir):
    return render.with_defaults(named_turns(spark, sf_dir)).select("doc_id", "chunk_id", render.compact_chunk().alias("block"))


SLUG = r"regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[-\s]+', '_', 'g')"
ROLE_SLUG = SLUG.format(t="role")


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, role FROM conversations)
    SELECT conv_id::VARCHAR AS node_id, 'Document' AS label, 'Untitled' AS name, conv_id AS doc_id, count(*) AS n FROM c GROUP BY conv_id
    UNION ALL SELECT conv_id || '_chunk_' || turn, 'Chunk', CASE WHEN length(t) > 200 THEN substring(t, 1, 200) || '...' ELSE t END, conv_id, {n_words('t')} FROM c
    UNION ALL SELECT conv_id || '_section_' || {ROLE_SLUG}, 'Section', role, conv_id, count(*) FROM c GROUP BY conv_id, role""")
def graph_nodes(spark, sf_dir):
    return render.graph_nodes(named_turns(spark, sf_dir))


@query(f"""SELECT 'PART_OF' AS kind, conv_id || '_chunk_' || turn AS from_node, conv_id::VARCHAR AS to_node FROM conversations
    UNION ALL SELECT 'HAS_SECTION', conv_id::VARCHAR, conv_id || '_section_' || {ROLE_SLUG} FROM conversations UNION ALL SELECT 'CONTAINS', conv_id || '_section_' || {ROLE_SLUG}, conv_id || '_chunk_' || turn FROM conversations""")
def graph_edges(spark, sf_dir):
    return render.graph_edges(named_turns(spark, sf_dir))


@query(f"""SELECT 'Document' AS class, conv_id || '_chunk_' || turn AS id, coalesce(text, '') AS content, conv_id::VARCHAR AS doc_id, turn AS chunk_index, role AS section_name, {n_words("coalesce(text, '')")} AS word_count FROM conversations""")
def vector_objects(spark, sf_dir):
    o = render.vector_objects(named_turns(spark, sf_dir))
    p = lambda n: F.col(f"properties.{n}")
    return o.select("class", "id", p("content").alias("content"), p("docId").alias("doc_id"), p("chunkIndex").alias("chunk_index"), p("sectionName").alias("section_name"), p("wordCount").alias("word_count"))


@query(f"""WITH w AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS s, length(text) AS n FROM documents WHERE text <> ''), p AS (SELECT doc_id, unnest(range(0, length(text), 1300)) AS s, length(text) AS n FROM documents WHERE text <> '')
    SELECT w.doc_id, w.s // 500 AS chunk_id, min(p.s // 1300) + 1 AS page_start, max(p.s // 1300) + 1 AS page_end FROM w JOIN p ON w.doc_id = p.doc_id AND p.s < least(w.s + 500, w.n) AND least(p.s + 1300, p.n) > w.s GROUP BY w.doc_id, w.s""")
def chunk_page_overlap(spark, sf_dir):
    d = documents(spark, sf_dir).where("text <> ''").select("doc_id", F.length("text").alias("n"))
    cut = lambda size: F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size)))
    spans = d.select("doc_id", "n", cut(500).alias("start_char")).select("doc_id", F.expr("start_char div 500").alias("chunk_id"), "start_char", F.least(F.col("start_char") + 500, "n").alias("end_char"))
    pages = d.select("doc_id", "n", cut(1300).alias("start")).select("doc_id", (F.expr("start div 1300") + 1).alias("page_no"), "start", F.least(F.col("start") + 1300, "n").alias("end"))
    return structure.overlapping(spans, pages)


@query(f"""SELECT source, count(*) FILTER (w >= 20) AS successful, count(*) FILTER (w < 20) AS failed, count(*) AS total FROM (SELECT source, {n_words("coalesce(text, '')")} AS w FROM documents) GROUP BY source""")
def batch_outcome(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("error", F.when(T.word_count("text") < 20, F.lit("too short")))
    return d.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count(F.lit(1)).alias("total"))


@query("SELECT doc_id, source, lang, length(coalesce(text, '')) AS total_chars, CASE WHEN length(coalesce(text, '')) > 300 THEN substring(text, 1, 300) ELSE coalesce(text, '') END AS text, length(coalesce(text, '')) > 300 AS truncated FROM documents")
def parse_projection(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "source", "lang", F.length("text").alias("total_chars"), F.substring("text", 1, 300).alias("text"), (F.length("text") > 300).alias("truncated"))


def pages_html(spark, sf_dir):
    """pages as HTML files, extracted by the reader."""
    prepare(spark)
    files = spread(table(spark, sf_dir, "pages")).select(F.format_string("%d.html", "page_id").alias("path"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    return parse_files(files).withColumn("page_id", F.regexp_extract("path", r"(\d+)\.html", 1).cast("long"))


def unescaped(t: str) -> str:
    """SQL for the few entities that the pages' titles, links and lists hold."""
    for name, sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        t = f"replace({t}, '{name}', {sign})"
    return t


TITLE, HREF, LABEL, ITEM = (unescaped(t) for t in ("regexp_extract(html, '<title>([^<]*)</title>', 1)", "regexp_extract(a, 'href=\"([^\"]*)\"', 1)", "regexp_extract(a, '>([^<]*)<', 1)", "regexp_replace(i, '<[^>]*>', '', 'g')"))


@query(f"""SELECT page_id, trim({TITLE}) AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language,
    len(regexp_extract_all(html, '<a href=')) AS num_links, len(regexp_extract_all(html, '<(ul|ol)>')) AS num_lists, len(regexp_extract_all(html, '<h[1-6]>')) AS num_headings FROM pages""")
def html_metadata(spark, sf_dir):
    field = lambda n, k="string": F.get_json_object("metadata", f"$.{n}").cast(k).alias(n)
    return pages_html(spark, sf_dir).select("page_id", field("title"), field("language"), field("num_links", "long"), field("num_lists", "long"), field("num_headings", "long"))


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS links FROM pages),
    x AS (SELECT page_id, generate_subscripts(links, 1) - 1 AS link_no, unnest(links) AS a FROM l)
    SELECT page_id, link_no, {HREF} AS url, trim({LABEL}) AS text FROM x""")
def html_links(spark, sf_dir):
    links = F.from_json(F.get_json_object("structure", "$.links"), "array<struct<url:string,text:string>>")
    return pages_html(spark, sf_dir).select("page_id", F.posexplode(links).alias("link_no", "l")).select("page_id", "link_no", "l.url", "l.text")


@query(f"""WITH l AS (SELECT page_id, flatten(list_transform(regexp_extract_all(html, '<ul>(.*?)</ul>', 1), lambda u: regexp_extract_all(u, '<li>(.*?)</li>', 1))) AS items FROM pages), x AS (SELECT page_id, generate_subscripts(items, 1) - 1 AS item_no, unnest(items) AS i FROM l)
    SELECT page_id, item_no, trim({ITEM}) AS item FROM x""")
def html_lists(spark, sf_dir):
    lists = F.from_json(F.get_json_object("structure", "$.lists"), "array<struct<items:array<string>>>")
    return pages_html(spark, sf_dir).select("page_id", F.posexplode(F.flatten(F.transform(lists, lambda x: x["items"]))).alias("item_no", "item"))


@query()
def html_markdown(spark, sf_dir):
    return pages_html(spark, sf_dir).select("page_id", F.col("text").alias("markdown"), "error")


@query()
def html_chunks(spark, sf_dir):
    return chunking.chunk(pages_html(spark, sf_dir).select("page_id", "text", "ext"), "auto", 200, 20, key="page_id", ext="ext")


@query("""SELECT CAST((r - 1) // 2 AS INT) AS chunk_id, conv_id, min(r) AS first_row, max(r) AS last_row, 'role|text' || chr(10) || string_agg(role || '|' || coalesce(text, ''), chr(10) ORDER BY r) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id, (r - 1) // 2""")
def table_row_chunks(spark, sf_dir):
    rows = turns(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), F.col("chunk_id").alias("turn"), F.concat_ws("|", "role", "text").alias("line"))
    return chunking.row_chunks(rows, "conv_id", "turn", "line", 2, F.lit("role|text"))


def page_lines(spark, sf_dir):
    """documents as paged books: a source is a book, a document a page, its lines stand one below the other.

    Size and weight follow from the line, so that the SQL can make the same table.
    """
    d = documents(spark, sf_dir).where("text <> ''")
    # Lines are counted before they become rows: beside the generator, the text would be split again for each of its lines.
    # The outer generator keeps the optimizer from asking for texts with lines where the file is read, which splits them twice.
    cut = d.select("source", "doc_id", structure.text_lines("text").alias("lines")).select("source", "doc_id", "lines", F.size("lines").alias("of"))
    rows = cut.select("source", "doc_id", "of", F.posexplode_outer("lines").alias("n", "text")).where("n IS NOT NULL")
    size = F.when(F.length("text") < 25, 16.0).when(F.length("text") < 45, 13.0).otherwise(11.0)
    return rows.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), (F.col("doc_id") * 100000 + F.col("n")).alias("ordinal"), "text", size.alias("size"), (F.length("text") % 7 == 0).alias("bold"), (F.col("n") / F.col("of")).alias("y_frac"))


LINES = r"""WITH d AS (SELECT source, doc_id, string_split(text, E'\n') AS ls FROM documents WHERE text <> ''),
    m AS (SELECT source, doc_id, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM d),
    u AS (SELECT source AS doc_id, doc_id AS page, generate_subscripts(ls, 1) - 1 AS n, len(ls) AS cnt, unnest(ls) AS text FROM m),
    l AS (SELECT doc_id, page, page * 100000 + n AS ordinal, text, CASE WHEN length(text) < 25 THEN 16.0 WHEN length(text) < 45 THEN 13.0 ELSE 11.0 END AS size, n / cnt AS y_frac FROM u)"""


@query(f"""{LINES}, s AS (SELECT doc_id, size, sum(length(text)) FILTER (y_frac >= 0.1 AND y_frac <= 0.9) AS mid FROM l GROUP BY ALL)
    SELECT doc_id, CAST(arg_max(size, mid) AS DOUBLE) AS body FROM s WHERE mid IS NOT NULL GROUP BY doc_id""")
def body_font_size(spark, sf_dir):
    return lines_ops.body_sizes(page_lines(spark, sf_dir))


FORM = r"lower(trim(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '\s+', ' ', 'g')))"
PLATE = " OR ".join(f"regexp_matches(text, '{p}')" for p in lines_ops.BOILERPLATE)


@query(f"""{LINES}, b AS (SELECT *, {FORM} AS form, (y_frac < 0.1 OR y_frac > 0.9) AND length(text) <= 120 AS banded FROM l),
    p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY ALL), c AS (SELECT doc_id, form, count(DISTINCT page) AS on_pages FROM b WHERE banded GROUP BY ALL),
    r AS (SELECT doc_id, form FROM c JOIN p USING (doc_id) WHERE on_pages >= greatest(3, floor(pages * 0.02)))
    SELECT b.doc_id, b.page, b.ordinal, CASE WHEN {PLATE} THEN 'boilerplate' ELSE 'running' END AS noise FROM b LEFT JOIN r ON b.doc_id = r.doc_id AND b.form = r.form AND b.banded WHERE r.form IS NOT NULL OR {PLATE}""")
def page_noise(spark, sf_dir):
    return lines_ops.with_noise(page_lines(spark, sf_dir), share=0.02).where("noise IS NOT NULL").select("doc_id", "page", "ordinal", "noise")


@query()
def page_headings(spark, sf_dir):
    geometry = [F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"), (F.col("ordinal") % 100000 * 20.0).alias("y0"), (F.col("ordinal") % 100000 * 20.0 + 10).alias("y1")]
    return lines_ops.headings(page_lines(spark, sf_dir).select("*", *geometry))


SIGN = lines_ops.MATH_SIGNS


@query(rf"""{LINES}, t AS (SELECT *, trim(text) AS t, regexp_replace(text, '\s', '', 'g') AS solid, regexp_matches(text, '{SIGN}') AS sign FROM l),
    x AS (SELECT *, (length(solid) - length(regexp_replace(solid, '\d|{SIGN}', '', 'g'))) / greatest(length(solid), 1) AS density FROM t),
    k AS (SELECT *, CASE WHEN t <> '' AND (regexp_matches(t, '^[\s\-_=|+]{{6,}}$') OR (regexp_matches(t, '\b(Dr|Cr|Debit|Credit)\b') AND {n_words('t')} <= 12) OR (contains(t, '|') AND NOT starts_with(t, '|') AND regexp_matches(t, '^[^|]*\d[^|]*\|.*\d'))) THEN 't_account'
        WHEN t <> '' AND NOT starts_with(t, '|') AND ((regexp_matches(t, '^[A-Za-z][\w\s()''-]{{0,40}}=\s*\S') AND sign) OR (density >= 0.3 AND regexp_matches(t, '\d') AND sign)) THEN 'formula' END AS kind FROM x)
    SELECT doc_id, page, ordinal, kind FROM k WHERE kind IS NOT NULL""")
def maths_lines(spark, sf_dir):
    return page_lines(spark, sf_dir).select("doc_id", "page", "ordinal", lines_ops.line_maths().alias("kind")).where("kind IS NOT NULL")


@query()
def maths_regions(spark, sf_dir):
    return lines_ops.math_regions(page_lines(spark, sf_dir))


@query()
def mid_sentence_ends(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", lines_ops.ends_mid_sentence("text").alias("broken_off"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, enriched and rendered: one compact text per document."""
    chunks = chunking.chunk(documents(spark, sf_dir), "auto", 200, 20).drop("section_name")
    return render.compact_documents(enrich.enrich(chunks))


QUERIES["enriched_compact"] = flagship
