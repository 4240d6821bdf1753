"""Registered queries over the driver's tables, each with its SQL where SQL can express it.

The tables hold no financial reports, so queries over tables, programs and outputs build their
strings from columns, run the operator, and are checked against the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyquill import store
from tallyquill.functions import markup, numbers, outputs, text, tokenizers
from tallyquill.operators import chunks, dialogue, engine, index, predictions, programs, retrieval, tables, terms, training
from tallyquill.shipping import ship
from tallyquill.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _shipped(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df


# --- dialogues -------------------------------------------------------------------------------------------------------

PAIRS = """
WITH p AS (
  SELECT conv_id AS id, turn, text AS question, lead(text) OVER w AS reply, role, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (
  SELECT id, turn, question, (length(reply) % 100)::VARCHAR AS gold,
         CASE WHEN length(question) % 3 = 0 THEN ((length(reply) % 100) * 1.005)::DOUBLE ELSE (length(question) % 90)::DOUBLE END AS value
  FROM p WHERE role = 'user' AND next_role = 'assistant')
"""
JUDGED = (
    PAIRS
    + """,
j AS (
  SELECT *, CASE WHEN gold::DOUBLE <> 0 THEN abs(value - gold::DOUBLE) / abs(gold::DOUBLE) <= 0.01 ELSE abs(value) <= 0.01 END AS is_correct FROM t),
d AS (
  SELECT id, sum(is_correct::INT)::BIGINT AS correct_count, count(*) AS total_turns,
         arg_min(is_correct::INT, turn) AS first_correct, arg_max(is_correct::INT, turn) AS last_correct,
         sum(is_correct::INT)::DOUBLE / count(*) AS accuracy
  FROM j GROUP BY id)
"""
)


def _judged(t) -> DataFrame:
    """User turns with the reply's length as the gold answer, and predictions some of which are right."""
    turns = dialogue.paired_turns(t("conversations"))
    gold, asked = F.length("reply") % 100, F.length("question")
    value = F.when(asked % 3 == 0, gold * F.lit(1.005).cast("double")).otherwise((asked % 90).cast("double"))
    turns = turns.select("id", "turn", "question", gold.cast("string").alias("gold"), text.double_text(value).alias("predicted"))
    return dialogue.judged(turns)


@query(JUDGED + "SELECT * FROM d")
def dialogue_metrics(t):
    """Per conversation counts and accuracies; the flagship."""
    return dialogue.per_dialogue(_judged(t))


@query(
    JUDGED
    + """
SELECT sum(correct_count)::DOUBLE / sum(total_turns) AS overall_accuracy, avg(accuracy) AS avg_example_accuracy, avg(first_correct) AS first_turn_accuracy,
       avg(last_correct) AS last_turn_accuracy, sum(correct_count)::BIGINT AS total_correct, sum(total_turns)::BIGINT AS total_turns, count(*) AS examples_evaluated FROM d"""
)
def corpus_metrics(t):
    """A2-A4."""
    return dialogue.corpus_metrics(dialogue.per_dialogue(_judged(t)))


@query(
    PAIRS
    + """
SELECT id, turn, coalesce(string_agg('Q' || n || ': ' || question || chr(10) || 'A' || n || ': ' || gold || chr(10) || chr(10), '')
         OVER (PARTITION BY id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS n FROM t)"""
)
def dialogue_history(t):
    """W1, F26."""
    turns = _judged(t).withColumn("predicted", F.col("gold"))
    return dialogue.with_history(turns).select("id", "turn", text.history_text(F.col("history")).alias("history"))


@query(
    PAIRS.replace("SELECT id, turn, question,", "SELECT id, turn, CASE id % 3 WHEN 0 THEN 'operating income in ' || (2010 + turn % 4) WHEN 1 THEN 'percentage increase?' ELSE 'What was the cash from operating activities in 2009 or ' || (2006 + turn) END AS question,")
    + """,
b AS (SELECT *, lag(question) OVER (PARTITION BY id ORDER BY turn) AS before FROM t)
SELECT id, turn, CASE WHEN question LIKE '%cash%' AND question LIKE '%operating activities%' AND question LIKE '%2009%' THEN '$206,588'
  WHEN question LIKE '%percentage%' AND before LIKE '%difference%' THEN '14' WHEN question LIKE '%operating income%' AND question LIKE '%2011%' THEN '1,314'
  WHEN question LIKE '%operating income%' AND question LIKE '%2010%' THEN '1,194' WHEN question LIKE '%percentage increase%' AND before LIKE '%operating income%' THEN '10.1%'
  ELSE 'Unable to find answer in context' END AS predicted FROM b"""
)
def mock_provider(t):
    """Rules over a question and the one before."""
    turns = dialogue.paired_turns(t("conversations"))
    asked = F.when(F.col("id") % 3 == 0, F.concat(F.lit("operating income in "), (2010 + F.col("turn") % 4).cast("string"))).when(F.col("id") % 3 == 1, F.lit("percentage increase?"))
    asked = asked.otherwise(F.concat(F.lit("What was the cash from operating activities in 2009 or "), (2006 + F.col("turn")).cast("string")))
    return dialogue.mock_answers(turns.withColumn("question", asked)).select("id", "turn", "predicted")


@query("""
SELECT c.conv_id, c.turn, coalesce(d.text, '') AS context FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 20 WHERE c.role = 'user'""")
def kb_lookup(t):
    """R1, J1."""
    asked = t("conversations").where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 20).alias("doc_id"))
    return retrieval.lookup(asked, t("documents").select("doc_id", "text"), "doc_id", "text").select("conv_id", "turn", "context")


@query("""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, string_split(text, chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, pos, ls[pos + 1] AS line FROM l WHERE length(ls[pos + 1]) - length(replace(ls[pos + 1], '|', '')) >= 2),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM f),
t AS (SELECT doc_id, min(pos)::INT AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS content FROM g GROUP BY doc_id, island)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1)::INT AS table_no, first_line, n_lines, content FROM t""")
def pipe_tables(t):
    """T1."""
    return tables.extract_tables(t("documents"))


@query("""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, string_split(text, chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, pos, ls[pos + 1] AS line, length(ls[pos + 1]) - length(replace(ls[pos + 1], '|', '')) >= 2 AS tab FROM l),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, tab ORDER BY pos) AS island FROM f),
p AS (SELECT doc_id, tab, min(pos) AS first_line, string_agg(line, chr(10) ORDER BY pos) AS content FROM g GROUP BY doc_id, tab, island),
q AS (SELECT doc_id, tab, first_line, CASE WHEN tab THEN content ELSE regexp_replace(content, '^\\s+|\\s+$', '', 'g') END AS content FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS n, bool_or(tab) OVER (PARTITION BY doc_id) AS has FROM q WHERE tab OR content <> '')
SELECT doc_id, CASE WHEN has THEN doc_id || '_' || CASE WHEN tab THEN 'table' ELSE 'text' END || '_' || n ELSE doc_id::VARCHAR END AS chunk_id,
       CASE WHEN tab THEN 'table' ELSE 'text' END AS type, n::INT AS chunk_no, content FROM k""".replace("\\\\", "\\"))
def document_chunks(t):
    """T3, T4."""
    return tables.split_document(t("documents"))


@query("""
SELECT n_regionkey AS id, ['name', 'key'] AS header, list([n_name, n_nationkey::VARCHAR] ORDER BY n_nationkey) AS rows, [false, true] AS numeric, [NULL, list(n_nationkey::DOUBLE ORDER BY n_nationkey)] AS numbers FROM nation GROUP BY n_regionkey""")
def parse_pipe_rows(t):
    """Pipe tables built from nations, parsed again."""
    line = F.concat(F.lit("| "), F.col("n_name"), F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    built = t("nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("ls"))
    content = F.concat(F.lit("| name | key |\n| --- | --- |\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    parsed = built.select("id", tables.parse_pipe_table(content).alias("p"), tables.table_data(content).alias("d"))
    return parsed.select("id", "p.header", "p.rows", "d.numeric", "d.numbers")


@query("""
WITH w AS (SELECT n_regionkey AS id, n_nationkey AS k, upper(n_name) || ' & ' || n_name AS c1, n_nationkey::VARCHAR AS c2 FROM nation),
a AS (SELECT id, k, c1, c2, greatest(max(length(c1)) OVER (PARTITION BY id), 4) AS w1, greatest(max(length(c2)) OVER (PARTITION BY id), 3) AS w2 FROM w)
SELECT id, rpad('name', any_value(w1)::INT, ' ') || ' | ' || rpad('key', any_value(w2)::INT, ' ') || ' | -' || chr(10) || repeat('-', any_value(w1)::INT) || '-|-' || repeat('-', any_value(w2)::INT) || '-|--' || chr(10)
       || string_agg(rpad(c1, w1::INT, ' ') || ' | ' || rpad(c2, w2::INT, ' ') || ' | ' || '-', chr(10) ORDER BY k) AS formatted FROM a GROUP BY id""".replace("'-|--'", "'-|-' || '-'"))
def html_table_format(t):
    """HTML tables built from nations, numbered rows, entities and empty cells included."""
    row = F.concat(F.lit("<tr><td>"), (F.col("n_nationkey") + 1).cast("string"), F.lit('</td><td class="x">'), F.upper("n_name"), F.lit(" &amp; <b>"), F.col("n_name"), F.lit("</b></td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td></td></tr>"))
    built = _shipped(t("nation")).groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rs"))
    html = F.concat(F.lit("<table><tr><th>0</th><th>name</th><th>key</th><td></td></tr>"), F.array_join(F.transform("rs", lambda x: x["row"]), ""), F.lit("</table>"))
    return built.select("id", tables.format_html_table(html).alias("formatted"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS ls, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS f FROM pages),
c AS (SELECT page_id, list_transform(ls, lambda x: [x]) || [['n', f]] AS rs FROM p)
SELECT page_id, list_transform(rs, lambda r: list_transform(r, lambda x: regexp_replace(
  replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g'))) AS table_rows FROM c""")
def page_tables(t):
    """Lists and footers of pages made tables of unclosed cells, read whole: numbered rows, all character references."""
    html = F.col("html")
    for said, now in (("<ul>", "<table><tbody>"), ("</ul>", "</table>"), ("<li>", "<tr><td>12<td>"), ("</li>", ""), ("<footer>", "<table><tr><th>n<td>"), ("</footer>", "")):
        html = F.replace(html, F.lit(said), F.lit(now))
    return _shipped(t("pages")).select("page_id", markup.rows_of(html).alias("table_rows"))


@query("""
SELECT 'doc_' || doc_id AS id, CASE WHEN lang = 'en' THEN lang || chr(10) || chr(10) ELSE chr(10) || chr(10) END || regexp_replace(source, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || text AS raw,
       '# doc_' || doc_id || chr(10) || chr(10) || CASE WHEN lang = 'en' THEN '## Pre-text' || chr(10) || chr(10) || lang || chr(10) || chr(10) ELSE '' END
       || '## Table' || chr(10) || chr(10) || source || chr(10) || chr(10) || '## Post-text' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) AS markdown
FROM documents""".replace("\\\\", "\\"))
def kb_transform(t):
    """Contexts and markdown of documents."""
    docs = t("documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("lang") == "en", F.col("lang")).otherwise("").alias("pre"), F.col("source").alias("table"), F.coalesce("text", F.lit("")).alias("post"))
    return docs.select("id", tables.context_text(F.col("pre"), F.col("table"), F.col("post")).alias("raw"), writers.markdown(F.col("id"), F.col("pre"), F.col("table"), F.col("post")).alias("markdown"))


# --- chunks and numbers ----------------------------------------------------------------------------------------------


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 50, 1), 462)) AS i FROM w WHERE len(ws) > 0)
SELECT doc_id, (i // 462)::INT AS chunk_no, len(ws[i + 1 : i + 512])::INT AS n_words, array_to_string(ws[i + 1 : i + 512], ' ') AS content FROM s""".replace("\\\\", "\\"))
def word_chunks(t):
    """C1b."""
    return chunks.word_chunks(t("documents"))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(0, greatest(len(ws) - 50, 1), 462)) // 462 AS c FROM w WHERE len(ws) > 0),
n AS (SELECT *, max(c) OVER (PARTITION BY doc_id) AS m FROM s)
SELECT doc_id, doc_id || '_text_chunk_' || c AS source, doc_id || '_text_chunk_' || CASE WHEN c = m THEN m - 1 ELSE m END AS target, CASE WHEN c = m THEN 1 ELSE m - c END::BIGINT AS distance FROM n WHERE m > 0""".replace("\\\\", "\\"))
def node_edges(t):
    """C4, M9."""
    nodes = chunks.word_chunks(t("documents").select("doc_id", "text"))
    return chunks.node_edges(nodes.select("doc_id", "chunk_no", F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("text_chunk"), F.col("chunk_no").cast("string")).alias("node_id")))


@query(r"""
WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?:\$\s*)?(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*%)?', 1), lambda x: replace(x, ',', '')::DOUBLE) AS ns FROM documents)
SELECT doc_id, len(ns) > 0 AS contains_numbers, len(ns)::INT AS number_count, ns[1:10] AS numbers FROM n""")
def number_annotation(t):
    """C2, C3."""
    return chunks.annotate(t("documents").select("doc_id", "text"), "text").select("doc_id", "contains_numbers", "number_count", "numbers")


@query("""
WITH v AS (
  SELECT 'total revenue' AS metric, l_quantity * 1e6 AS value FROM lineitem UNION ALL SELECT 'profit margin (%)', l_discount * 100 / 100 FROM lineitem
  UNION ALL SELECT 'store units', l_linenumber::DOUBLE FROM lineitem)
SELECT metric, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max, count(*) AS n FROM v WHERE metric <> 'store units' GROUP BY metric""")
def metric_stats(t):
    """Sentences built from line items; counts aren't asked for."""
    rows = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("node_id"), "l_quantity", "l_discount", "l_linenumber")
    said = F.concat(F.lit("total revenue was $"), F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.lit(" million; profit margin: "), (F.col("l_discount") * 100).cast("decimal(8,2)").cast("string"), F.lit("%. "), F.col("l_linenumber").cast("string"), F.lit(" store units"))
    values = predictions.metric_values(_shipped(rows).select("node_id", said.alias("content")))
    wanted = rows.sparkSession.createDataFrame([("total revenue",), ("profit margin (%)",)], "metric string")
    return predictions.metric_stats(values, wanted)


@query(r"""
WITH m AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?:\$|USD)?\s*([\d,]+\.?\d*)\s*(?:million|billion|thousand|m|b|k|%)?') AS ms, regexp_extract_all(text, '(?:\$|USD)?\s*([\d,]+\.?\d*)\s*(?:million|billion|thousand|m|b|k|%)?', 1) AS ds,
    regexp_split_to_array(text, '(?:\$|USD)?\s*([\d,]+\.?\d*)\s*(?:million|billion|thousand|m|b|k|%)?') AS ps FROM documents),
u AS (SELECT doc_id, text, unnest(ms) AS m, unnest(ds) AS d, unnest(ps[:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0),
f AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM u),
x AS (SELECT *, stop - length(m) AS start, substr(text, stop + 1, 10) AS behind, try_cast(replace(d, ',', '') AS DOUBLE) AS v FROM f)
SELECT doc_id, v * CASE WHEN contains(behind, 'billion') THEN 1e9 WHEN contains(behind, 'million') THEN 1e6 WHEN contains(behind, 'thousand') THEN 1e3 WHEN contains(behind, 'b') THEN 1e9 WHEN contains(behind, 'm') THEN 1e6 WHEN contains(behind, 'k') THEN 1e3 ELSE 1 END
    / CASE WHEN starts_with(behind, '%') THEN 100 ELSE 1 END AS value, contains(substr(text, greatest(0, start - 1) + 1, stop + 1 - greatest(0, start - 1)), '$') AS is_currency, starts_with(behind, '%') AS is_percentage,
  regexp_replace(substr(text, greatest(0, start - 30) + 1, stop + 30 - greatest(0, start - 30)), '^\s+|\s+$', '', 'g') AS context, start::INT AS position FROM x WHERE v IS NOT NULL""")
def number_details(t):
    """Numbers with context, unit and sign."""
    docs = _shipped(t("documents")).select("doc_id", F.explode(numbers.all_numbers(F.col("text"))).alias("n"))
    return docs.select("doc_id", "n.*")


def _packing(length: str, size: int, overlap: int, counted: str) -> str:
    """Sentences packed by a recursive query, a chunk a step: its first and last sentence, by the running sums of lengths."""
    return f"""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS ss FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, ss, list_transform(ss, lambda x: {length}) AS ns FROM s WHERE len(ss) > 0),
u AS (SELECT doc_id, unnest(ns) AS n, generate_subscripts(ns, 1) AS i FROM w),
c AS (SELECT doc_id, list(total ORDER BY i) AS upto FROM (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS total FROM u) GROUP BY doc_id),
r AS (
  SELECT doc_id, 0 AS chunk_no, 1 AS a, greatest(1, len(list_filter(upto, lambda x: x <= {size}))) AS b, upto FROM c
  UNION ALL
  SELECT doc_id, chunk_no + 1, t, greatest(b + 1, len(list_filter(upto, lambda x: x <= coalesce(upto[t - 1], 0) + {size}))), upto FROM (
    SELECT doc_id, chunk_no, b, upto, CASE WHEN upto[b + 1] - coalesce(upto[k - 1], 0) <= {size} THEN k ELSE b + 1 END AS t FROM (
      SELECT *, least(b + 1, greatest(a + 1, len(list_filter(upto, lambda x: x < upto[b] - {overlap})) + 2)) AS k FROM r WHERE b < len(upto))))
SELECT doc_id, chunk_no::INT AS chunk_no, doc_id || '_text_chunk_' || chunk_no AS node_id, (upto[b] - coalesce(upto[a - 1], 0))::INT AS {counted}, array_to_string(ss[a:b], ' ') AS content FROM r JOIN w USING (doc_id)"""


@query(_packing("len(regexp_extract_all(x, '\\S+'))", 128, 20, "n_words"))
def sentence_chunks(t):
    """Whole sentences packed into chunks, by words."""
    return chunks.sentence_chunks(_shipped(t("documents")), size=128, overlap=20)


@query(_packing("len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]{1,4}'))", 256, 40, "n_tokens"))
def token_chunks(t):
    """Whole sentences packed into chunks, by the tokens that a tokenizer gives."""
    return chunks.sentence_chunks(_shipped(t("documents")), size=256, overlap=40, tokenizer=tokenizers.plain())


@query("""
SELECT doc_id, lang, text, count(*) OVER () AS n FROM documents""")
def json_arrays(t):
    """Documents written as JSON arrays and read back in splits; each object's place in its file is its own."""
    docs = _shipped(t("documents")).select("doc_id", "lang", "text")
    path = store.fresh(docs.sparkSession, "arrays")
    writers.write_arrays(docs, path)
    read = readers.read_numbered(docs.sparkSession, path, docs.schema.simpleString()[7:-1].replace(":", " "))
    places = read.groupBy("__file").agg(F.count_distinct("seq").alias("n"), F.max("seq").alias("last")).where("n = last + 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return read.select("doc_id", "lang", "text").join(F.broadcast(places))  # one row


@query("""
WITH RECURSIVE p AS (
  SELECT conv_id AS id, turn, text AS question, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT id, turn, question, row_number() OVER (PARTITION BY id ORDER BY turn) AS k FROM p WHERE role = 'user' AND next_role = 'assistant'),
r AS (
  SELECT id, turn, k, coalesce(length(question), 0) % 97 AS said, coalesce(length(question), 0) % 97 AS total FROM t WHERE k = 1
  UNION ALL SELECT t.id, t.turn, t.k, (coalesce(length(t.question), 0) + r.total + r.k) % 97, r.total + (coalesce(length(t.question), 0) + r.total + r.k) % 97 FROM r JOIN t ON t.id = r.id AND t.k = r.k + 1)
SELECT id, turn, said::VARCHAR AS predicted FROM r""")
def dialogue_rounds(t):
    """Answers that depend on all answers before, given in rounds over all dialogues."""
    turns = _shipped(dialogue.paired_turns(t("conversations"))).select("id", "turn", "question", F.lit("").alias("context"))
    answer = lambda asked: [str((len(q or "") + sum(int(a) for _, a in h) + len(h)) % 97) for q, _, h in asked]
    return dialogue.provider_rounds(turns, answer, few=8).select("id", "turn", "predicted")


# --- retrieval -------------------------------------------------------------------------------------------------------

VECTORS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
h AS (
  SELECT q.vec_id AS query_id, n.vec_id AS node_id, n.label < 3 AS is_table, list_cosine_similarity(q.e, n.e) AS score FROM v q JOIN v n ON n.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
a AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, is_table ORDER BY round(score, 9) DESC, node_id) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS sc FROM h)
"""


def _hits(t, k: int) -> DataFrame:
    """One search over all vectors but the query's own, which is one of the k + 1 best; those of small labels stand for tables.

    Its hits are written once, as several steps read them.
    """
    v = _shipped(t("embeddings")).select("vec_id", F.col("embedding").alias("vec"), (F.col("label") < 3).cast("int").alias("is_table"))
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    found = retrieval.vector_topk(queries, v.withColumnRenamed("vec_id", "node_id"), k + 1, by=F.col("is_table")).where("query_id <> node_id")
    order = Window.partitionBy("query_id", "part").orderBy("seq")
    return store.once(found.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= k), "hits")


def _collections(t, k: int = 5):
    """Hits of the text, the table and the context collection."""
    return retrieval.collection_hits(_hits(t, k), k)


@query(VECTORS + "SELECT query_id, node_id, round(score, 6) AS score, sc::INT AS seq FROM a WHERE sc <= 5")
def vector_topk(t):
    """R3, R4, J7, O1."""
    return _collections(t)[2].select("query_id", "node_id", F.round("score", 6).alias("score"), "seq")


@query(VECTORS + "SELECT query_id, node_id, round(score, 6) AS score, s::INT AS seq, is_table FROM a WHERE s <= 5")
def stored_search(t):
    """An index is written and read back; each query asks for its nearest texts, and for its nearest tables."""
    v = _shipped(t("embeddings")).select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"), (F.col("label") < 3).cast("int").alias("collection"))
    spark = v.sparkSession
    path = store.fresh(spark, "index")
    index.build(v, path)
    held = index.load(spark, path)
    asked = v.where("node_id % 20 = 0").select((F.col("node_id") * 2).alias("query_id"), "vec")
    asked = asked.union(asked.select(F.col("query_id") + 1, "vec"))  # one query a collection
    found = index.search(held, asked, 6, F.array(F.col("query_id") % 2)).select(F.floor(F.col("query_id") / 2).alias("query_id"), "node_id", "score", "seq", (F.col("query_id") % 2 == 1).alias("is_table")).where("query_id <> node_id")
    order = Window.partitionBy("query_id", "is_table").orderBy("seq")
    return found.withColumn("seq", F.row_number().over(order)).where("seq <= 5").select("query_id", "node_id", F.round("score", 6).alias("score"), "seq", "is_table")


MERGED = (
    VECTORS
    + """,
u AS (SELECT query_id, node_id, score, s + CASE WHEN is_table THEN 100 ELSE 0 END AS seq FROM a WHERE s <= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq, node_id) AS n FROM u WHERE score >= 0.3),
kept AS (SELECT query_id, node_id, score FROM k WHERE n <= 3),
tx AS (SELECT a.query_id, a.node_id, a.score, row_number() OVER (PARTITION BY a.query_id ORDER BY a.s, a.node_id) AS n FROM a ANTI JOIN kept USING (query_id, node_id) WHERE a.is_table AND a.s <= 5),
cx AS (SELECT a.query_id, a.node_id, a.score, row_number() OVER (PARTITION BY a.query_id ORDER BY a.sc, a.node_id) AS n FROM a ANTI JOIN u USING (query_id, node_id) WHERE a.sc <= 5),
r AS (SELECT *, 'kept' AS part FROM kept UNION ALL SELECT query_id, node_id, score, 'table' FROM tx WHERE n <= 2 UNION ALL SELECT query_id, node_id, score, 'context' FROM cx WHERE n <= 2)
"""
)


def _retrieved(hits: DataFrame) -> DataFrame:
    texts, tabs, contexts = retrieval.collection_hits(hits, 5)
    return retrieval.retrieve(texts, tabs.withColumn("seq", F.col("seq") + 100), contexts, least=0.3)


@query(MERGED + "SELECT query_id, node_id, round(score, 6) AS score, part FROM r")
def multi_query_merge(t):
    """Merged, cut off, topped up with tables and contexts."""
    return _retrieved(_hits(t, 5)).select("query_id", "node_id", F.round("score", 6).alias("score"), "part")


@query(MERGED + "SELECT query_id, count(*) FILTER (part = 'kept') AS n_kept, count(*) FILTER (part = 'table') AS n_table, count(*) FILTER (part = 'context') AS n_context, count(*) AS n_all, round(max(score), 6) AS best FROM r GROUP BY query_id")
def retrieval_envelope(t):
    """R10, A11."""
    return retrieval.envelope(_retrieved(_hits(t, 5))).withColumn("best", F.round("best", 6))


@query(
    MERGED.replace("WITH v AS", "WITH w AS (SELECT conv_id * 20 AS query_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 3) AS ks FROM conversations WHERE turn = 0), v AS")
    + """,
x AS (
  SELECT a.query_id, a.node_id, a.sc, row_number() OVER (PARTITION BY a.query_id ORDER BY a.sc, a.node_id) AS n
  FROM a ANTI JOIN r USING (query_id, node_id) JOIN w ON w.query_id = a.query_id JOIN documents d ON d.doc_id = a.node_id
  WHERE a.sc <= 20 AND len(list_filter(w.ks, lambda x: contains(lower(d.text), x))) > 0)
SELECT query_id, node_id, sc::INT AS seq FROM x WHERE n <= 3"""
)
def hybrid_keyword(t):
    """Contexts among the twenty nearest that hold a keyword of the question."""
    asked = t("conversations").where("turn = 0").select((F.col("conv_id") * 20).alias("query_id"), text.keywords(F.col("text")).alias("keywords"))
    docs = t("documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("content"))
    hits = _hits(t, 20)
    candidates = retrieval.collection_hits(hits, 20)[2].join(asked, "query_id").join(docs, "node_id")
    return retrieval.keyword_hits(candidates, _retrieved(hits)).select("query_id", "node_id", "seq")


@query(
    VECTORS
    + """,
b AS (SELECT a.*, a.node_id % 7 = 0 OR is_table AS num FROM a WHERE sc <= 5),
n AS (SELECT query_id, count(*) FILTER (num) AS nn FROM b GROUP BY query_id),
e AS (SELECT a.query_id, a.node_id, a.s, n.nn, row_number() OVER (PARTITION BY a.query_id ORDER BY a.s, a.node_id) AS m FROM a ANTI JOIN (SELECT * FROM b WHERE num) b USING (query_id, node_id) JOIN n ON n.query_id = a.query_id AND n.nn < 3 WHERE a.is_table AND a.s <= 10)
SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY part, seq, node_id) AS rank
FROM (SELECT query_id, node_id, CASE WHEN num THEN 0 ELSE 2 END AS part, sc AS seq FROM b UNION ALL SELECT query_id, node_id, 1, s FROM e WHERE m <= 5 - nn)"""
)
def numeric_focus(t):
    """Numeric nodes and tables first, topped up with tables, the others last."""
    hits = _hits(t, 10)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "node_id")
    contexts = hits.withColumn("seq", F.row_number().over(order)).where("seq <= 5")
    _, tabs, _ = retrieval.collection_hits(hits, 10)
    return retrieval.numeric_first(contexts.withColumn("numeric", (F.col("node_id") % 7 == 0) | (F.col("part") == 1)), tabs)


# --- answers, outputs, programs --------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, round(l_discount * 100) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN d::BIGINT || '.0%' WHEN 1 THEN q::BIGINT || '.0' WHEN 2 THEN q::BIGINT::VARCHAR ELSE 'not ' || q::BIGINT END AS normal,
       CASE l_linenumber % 4 WHEN 3 THEN false WHEN 0 THEN true WHEN 1 THEN true ELSE true END AS correct, l_linenumber % 4 <> 3 AS within FROM b""")
def answer_normalize(t):
    """Answers in several spellings, built from line items."""
    q, d, k = F.col("l_quantity").cast("long").cast("string"), F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.col("l_linenumber") % 4
    said = F.when(k == 0, F.concat(F.lit("so <answer> "), d, F.lit(" %</answer>"))).when(k == 1, F.concat(F.lit("<answer>$"), q, F.lit("</answer>"))).when(k == 2, F.concat(F.lit("The answer is "), q, F.lit(".0 in all"))).otherwise(F.concat(F.lit("Not "), q))
    answer = F.when(k == 2, q).otherwise(text.extract_answer(said))
    gold = F.when(k == 0, d).when(k == 3, F.lit("x")).otherwise(q)
    plain = F.regexp_replace(answer, "[$% ]", "")
    return t("lineitem").select("l_orderkey", "l_linenumber", text.normalize_answer(answer).alias("normal"), text.is_answer_correct(answer, gold).alias("correct"), text.answer_within(plain, gold).alias("within"))


OUTPUTS = """
WITH b AS (SELECT o_orderkey AS id, o_orderkey % 5 AS kind, (o_custkey % 1000)::VARCHAR AS a, (o_orderkey % 77)::VARCHAR AS c FROM orders)
"""


def _outputs(t) -> DataFrame:
    """Raw outputs of five kinds, built from orders."""
    k, a, c = F.col("o_orderkey") % 5, (F.col("o_custkey") % 1000).cast("string"), (F.col("o_orderkey") % 77).cast("string")
    program = F.concat(F.lit("add( "), a, F.lit(".5 "), c, F.lit(" ) EOF"))
    raw = (
        F.when(k == 0, F.concat(F.lit("noise <begin_of_program> "), program, F.lit(" <end_of_program> more\n<begin_of_answer>"), a, F.lit("<end_of_answer>")))
        .when(k == 1, F.concat(F.lit("<begin_of_answer>\n$"), a, F.lit("\n<end_of_answer> and nothing else")))
        .when(k == 2, F.concat(F.lit("The answer is "), a, F.lit(" for sure")))
        .when(k == 3, F.concat(F.lit("<begin_of_program>and<end_of_program><begin_of_answer>the<end_of_answer> "), a, F.lit(" then "), c))
        .otherwise(F.concat(F.lit("add( "), a, F.lit(" "), c, F.lit(" ) EOF")))
    )
    return t("orders").select(F.col("o_orderkey").alias("id"), raw.alias("output"))


@query(
    OUTPUTS
    + """
SELECT id, '<begin_of_program>' || chr(10) || CASE kind WHEN 0 THEN 'add( ' || a || '.5 ' || c || ' ) EOF' WHEN 3 THEN 'and' ELSE 'EOF' END || chr(10) || '<end_of_program>' || chr(10) || chr(10)
       || '<begin_of_answer>' || chr(10) || CASE kind WHEN 0 THEN a WHEN 1 THEN '$' || a WHEN 3 THEN 'the' ELSE 'N/A' END || chr(10) || '<end_of_answer>' AS cleaned,
       CASE kind WHEN 0 THEN a WHEN 1 THEN '$' || a WHEN 2 THEN a WHEN 3 THEN 'the' ELSE c END AS answer, kind = 0 AS valid, kind = 0 AS format_ok,
       CASE kind WHEN 0 THEN a::DOUBLE WHEN 1 THEN a::DOUBLE WHEN 2 THEN a::DOUBLE END AS num FROM b"""
)
def output_clean(t):
    """F5, F6, F10-F13."""
    c = F.col("output")
    return _outputs(t).select("id", text.clean_output(c).alias("cleaned"), text.robust_answer(c).alias("answer"), text.is_valid_output(c).alias("valid"), text.validate_format(c).alias("format_ok"), text.training_answer(c)["num"].alias("num"))


@query(
    OUTPUTS
    + """
SELECT id, CASE kind WHEN 0 THEN ['add(', a || '.5', c, ')', 'EOF'] WHEN 1 THEN ['EOF'] WHEN 2 THEN ['EOF'] WHEN 3 THEN ['add(', a, c, ')', 'EOF'] ELSE ['add(', a, c, ')', 'EOF'] END AS predicted FROM b"""
)
def output_rescue(t):
    """Program tokens rescued from raw outputs."""
    return _shipped(_outputs(t)).select("id", outputs.formatted_prediction_of(F.col("output")).alias("predicted"))


@query(
    OUTPUTS
    + """,
x AS (SELECT *, 'add( ' || a || ' ' || c || ' ) EOF' AS p FROM b),
r AS (
  SELECT id, CASE kind WHEN 0 THEN ['add( ' || a || '.5 ' || c || ' ) EOF', a] WHEN 1 THEN ['EOF', '$' || a] WHEN 2 THEN ['EOF', a] WHEN 3 THEN ['and', 'the'] ELSE [p, a] END AS cleaned,
    CASE kind WHEN 0 THEN ['add( ' || a || '.5 ' || c || ' ) EOF', a] WHEN 1 THEN ['<begin_of_answer>' || chr(10) || '$' || a || chr(10) || '<end_of_answer> and nothing else'] WHEN 2 THEN ['The answer is ' || a || ' for sure']
      WHEN 3 THEN ['and', 'the'] ELSE [p, (a::INT + c::INT) || '.0'] END AS rescued FROM x)
SELECT id, '<begin_of_program>' || chr(10) || cleaned[1] || chr(10) || '<end_of_program>' || chr(10) || chr(10) || '<begin_of_answer>' || chr(10) || cleaned[2] || chr(10) || '<end_of_answer>' AS cleaned,
  CASE WHEN len(rescued) = 1 THEN rescued[1] ELSE '<begin_of_program>' || chr(10) || rescued[1] || chr(10) || '<end_of_program>' || chr(10) || chr(10) || '<begin_of_answer>' || chr(10) || rescued[2] || chr(10) || '<end_of_answer>' END AS rescued FROM r"""
)
def output_rescue_blocks(t):
    """Whole blocks rescued."""
    return _shipped(_outputs(t)).select("id", outputs.clean_of(F.col("output")).alias("cleaned"), outputs.rescue_of(F.col("output"), F.lit("llama-3.3")).alias("rescued"))


@query("""
SELECT l_orderkey, l_linenumber, 0 AS invalid, round((l_extendedprice - l_quantity) / 3.0, 5) AS num, NULL::VARCHAR AS str FROM lineitem WHERE l_linenumber % 3 = 0
UNION ALL SELECT l_orderkey, l_linenumber, 0, NULL, CASE WHEN l_quantity > l_linenumber * 10 THEN 'yes' ELSE 'no' END FROM lineitem WHERE l_linenumber % 3 = 1
UNION ALL SELECT l_orderkey, l_linenumber, 1, round(l_quantity - 3, 5), NULL FROM lineitem WHERE l_linenumber % 3 = 2""")
def program_eval(t):
    """Programs built from line items: two steps, a comparison, a division by zero."""
    k, q, p = F.col("l_linenumber") % 3, text.double_text(F.col("l_quantity")), F.col("l_extendedprice").cast("decimal(14,2)").cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit("subtract("), p, F.lit(", "), q, F.lit("), divide(#0, const_3)")))
        .when(k == 1, F.concat(F.lit("greater("), q, F.lit(", "), (F.col("l_linenumber") * 10).cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("subtract("), q, F.lit(", const_3), divide(#0, 0)")))
    )
    r = programs.rounded(F.col("r"))
    return _shipped(t("lineitem")).withColumn("r", programs.evaluate(programs.tokenize(said))).select("l_orderkey", "l_linenumber", r["invalid"].alias("invalid"), r["num"].alias("num"), r["str"].alias("str"))


@query("""
SELECT o_orderkey AS id, 'multiply( ' || o_custkey || ' 2 ) divide( ' || o_orderkey || ' #0 ) EOF' AS flat, round(o_orderkey / (o_custkey * 2.0), 5) AS num FROM orders WHERE o_custkey > 0""")
def program_nested(t):
    """Nested programs made flat, then run."""
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    nested = F.array(F.lit("divide("), o, F.lit("multiply("), c, F.lit("2"), F.lit(")"), F.lit(")"))
    flat = F.concat(programs.flatten(nested), F.array(F.lit("EOF")))
    return _shipped(t("orders")).where("o_custkey > 0").select(F.col("o_orderkey").alias("id"), programs.tokens_text(flat).alias("flat"), F.round(programs.evaluate(flat)["num"], 5).alias("num"))


@query("""
SELECT p_brand AS brand, max(p_retailprice) AS max, min(p_retailprice) AS min, round(sum(p_retailprice), 4) AS sum, round(avg(p_retailprice), 4) AS average, round(max(p_retailprice), 5) AS program FROM part GROUP BY p_brand""")
def table_ops(t):
    """A12, F19, P2's table steps: a row of prices per brand."""
    cell = F.concat(F.lit("$ "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" (a)"))
    rows = t("part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_list(cell).alias("cells"))
    s = programs.table_stats(F.col("cells"))
    ran = programs.evaluate(F.array(F.lit("table_max("), F.col("brand"), F.lit("none"), F.lit(")"), F.lit("EOF")), F.create_map("brand", "cells"))
    return _shipped(rows).select("brand", s["max"].alias("max"), s["min"].alias("min"), F.round(s["sum"], 4).alias("sum"), F.round(s["average"], 4).alias("average"), F.round(ran["num"], 5).alias("program"))


def _scored_pairs(t) -> DataFrame:
    """Predictions of four kinds beside the gold programs of their ids."""
    k, o, c = F.col("o_orderkey") % 4, (F.col("o_orderkey") + 7).cast("string"), (F.col("o_custkey") + 1).cast("string")
    tokens = lambda *x: F.array(*(y if not isinstance(y, str) else F.lit(y) for y in x))
    gold = tokens("add(", o, c, ")", "divide(", "#0", c, ")", "EOF")
    turned = tokens("divide(", o, c, ")", "divide(", c, c, ")", "add(", "#0", "#1", ")", "EOF")
    wrong = tokens("add(", o, "5", ")", "divide(", "#0", "3", ")", "EOF")
    pred = F.when(k == 0, gold).when(k == 1, turned).when(k == 2, wrong).otherwise(tokens("add(", o, ")", "EOF"))
    value = (F.col("o_orderkey") + 7 + F.col("o_custkey") + 1) / (F.col("o_custkey") + 1)
    rows = _shipped(t("orders"))
    return programs.with_gold(rows.select(F.col("o_orderkey").alias("id"), k.alias("kind"), pred.alias("pred")), rows.select(F.col("o_orderkey").alias("id"), gold.alias("gold"), value.alias("exe_ans")))


@query("""
SELECT o_orderkey % 4 AS kind, count(*) AS n, count(*) FILTER (o_orderkey % 4 < 2) AS exe_right, count(*) FILTER (o_orderkey % 4 < 2) AS prog_right, count(*) FILTER (o_orderkey % 4 = 3) AS invalid FROM orders GROUP BY 1""")
def program_scores(t):
    """Predictions against the gold programs of their ids: the same, turned round, with a wrong operand, broken."""
    return programs.scores(_scored_pairs(t)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("exe_right").alias("exe_right"), F.count_if("prog_right").alias("prog_right"), F.count_if(F.col("invalid") == 1).alias("invalid"))


@query("""
SELECT count(*) AS n, count(*) FILTER (o_orderkey % 4 < 2) / count(*)::DOUBLE AS exe_acc, count(*) FILTER (o_orderkey % 4 < 2) / count(*)::DOUBLE AS prog_acc, 0::BIGINT AS unsound FROM orders""")
def program_accuracy(t):
    """The two accuracies among all predictions."""
    return programs.accuracies(programs.scores(_scored_pairs(t)))


@query("""
SELECT count(*) AS n, 1.0::DOUBLE AS exe_acc, 1.0::DOUBLE AS prog_acc, 0::BIGINT AS unsound FROM orders""")
def program_accuracy_nested(t):
    """Nested predictions and gold programs, made flat before they are compared."""
    o, c = (F.col("o_orderkey") + 7).cast("string"), (F.col("o_custkey") + 1).cast("string")
    tokens = lambda *x: F.array(*(y if not isinstance(y, str) else F.lit(y) for y in x))
    gold, pred = tokens("divide(", o, "add(", c, o, ")", ")", "EOF"), tokens("divide(", o, "add(", o, c, ")", ")")
    value = (F.col("o_orderkey") + 7) / (F.col("o_custkey") + 1 + F.col("o_orderkey") + 7)
    rows = _shipped(t("orders")).select(gold.alias("gold"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(pred, F.array(F.lit("EOF")))).otherwise(pred).alias("pred"), value.alias("exe_ans"))
    return programs.accuracies(programs.nested_scores(rows))


def _matched(t) -> DataFrame:
    """Predictions beside labels: equal, near, of another type, blank, untagged."""
    k, v = F.col("o_orderkey") % 5, (F.col("o_custkey") % 500).cast("string")
    tag = lambda x: F.concat(F.lit("<begin_of_program>\nEOF\n<end_of_program>\n\n<begin_of_answer>\n"), x, F.lit("\n<end_of_answer>"))
    pred = F.when(k == 0, tag(v)).when(k == 1, tag(F.concat(v, F.lit(".001")))).when(k == 2, tag(F.lit("Yes"))).when(k == 3, F.lit("  ")).otherwise(F.lit("no idea"))
    label = F.when(k == 2, tag(F.lit("yes it is"))).otherwise(tag(v))
    return t("orders").select(F.col("o_orderkey").alias("id"), pred.alias("pred"), label.alias("label"))


@query("""
WITH b AS (SELECT o_orderkey % 5 AS k FROM orders)
SELECT count(*) AS total_samples, 0::BIGINT AS program_token_matches, count(*) FILTER (k < 2) AS numerical_answers, count(*) FILTER (k IN (2, 4)) AS string_answers, count(*) FILTER (k = 4) AS answer_type_mismatches,
  count(*) FILTER (k = 3) AS empty_predictions, count(*) FILTER (k = 0) AS exact_matches, count(*) FILTER (k < 2) AS format_valid,
  100.0::DOUBLE AS total_samples_pct, 0.0::DOUBLE AS program_token_matches_pct, count(*) FILTER (k < 2) / count(*)::DOUBLE * 100 AS numerical_answers_pct, count(*) FILTER (k IN (2, 4)) / count(*)::DOUBLE * 100 AS string_answers_pct,
  count(*) FILTER (k = 4) / count(*)::DOUBLE * 100 AS answer_type_mismatches_pct, count(*) FILTER (k = 3) / count(*)::DOUBLE * 100 AS empty_predictions_pct, count(*) FILTER (k = 0) / count(*)::DOUBLE * 100 AS exact_matches_pct,
  count(*) FILTER (k < 2) / count(*)::DOUBLE * 100 AS format_valid_pct FROM b""")
def prediction_profile(t):
    """A9, F11, F13."""
    return predictions.profile(_matched(t))


@query("""
WITH b AS (SELECT o_orderkey % 5 AS k FROM orders) SELECT 100.0::DOUBLE AS program_match, count(*) FILTER (k < 3) / count(*)::DOUBLE * 100 AS answer_match FROM b""")
def prediction_matches(t):
    """A8, A10."""
    return predictions.match_rates(predictions.with_matches(_shipped(_matched(t))))


# --- training data ---------------------------------------------------------------------------------------------------


@query("""
WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: (length(x) % 11)::INT) AS ids FROM documents),
m AS (SELECT doc_id, ids, list_position(list_transform(ids, lambda x, i: x = 2 AND i < len(ids) AND ids[i + 1] = 3), true) AS p FROM w)
SELECT doc_id, list_transform(ids, lambda x, i: CASE WHEN p > 0 AND i >= p THEN x ELSE -100 END) AS labels, CASE WHEN p > 0 THEN p - 1 END::INT AS marker_at, ids[1:8] AS head FROM m""")
def label_mask(t):
    """Response labels over word lengths as ids, the marker being 2, 3."""
    ids = F.transform(F.split("text", " "), lambda x: F.length(x) % 11)
    marker = F.array(F.lit(2), F.lit(3))
    docs = t("documents").select("doc_id", ids.alias("ids"))
    both = training.same_length(F.col("ids"), F.slice("ids", 1, 8))
    return docs.select("doc_id", training.response_labels(F.col("ids"), marker).alias("labels"), training.marker_at(F.col("ids"), marker).alias("marker_at"), both["ids"].alias("head"))


ASK, SAY = "### Instruction:\n", "### Response:\n"
PIECES = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]{{1,4}}')"


@query(f"""
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 <> 2 THEN '{ASK[:-1]}' || chr(10) WHEN role = 'assistant' AND conv_id % 4 = 1 THEN 'so' || '{SAY[:-1]}' || chr(10) WHEN role = 'assistant' THEN '{SAY[:-1]}' || chr(10) ELSE '' END || coalesce(text, '') AS said FROM conversations),
c AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN string_agg(said, ' ' ORDER BY turn) ELSE string_agg(said, chr(10) ORDER BY turn) END AS text FROM m GROUP BY conv_id),
p AS (SELECT *, strpos(text, '{ASK[:-1]}' || chr(10)) AS a FROM c),
q AS (SELECT *, CASE WHEN a > 0 THEN strpos(substr(text, a + {len(ASK)}), '{SAY[:-1]}' || chr(10)) ELSE 0 END AS z FROM p),
b AS (SELECT *, CASE WHEN z > 0 THEN a + {len(ASK)} - 1 + z - 1 END AS place FROM q),
k AS (SELECT *, list_transform({PIECES.format("text")}, lambda x: ((length(x) * 131 + ord(x) * 7 + ord(substr(x, length(x), 1))) % 32000)::INT) AS ids, {PIECES.format("substr(text, 1, place)")} AS pre FROM b),
n AS (SELECT *, len(pre) - CASE WHEN len(pre) > 0 AND length(pre[-1]) < 4 AND regexp_matches(substr(text, place, 1), '[^\\x20\\x09-\\x0D]') THEN 1 ELSE 0 END AS before FROM k)
SELECT conv_id, (ids || list_transform(range(64), lambda i: 0))[1:64] AS input_ids, list_transform(range(64), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS attention_mask,
  CASE WHEN place IS NOT NULL THEN (list_transform(ids, lambda x, i: CASE WHEN i > before THEN x ELSE -100 END) || list_transform(range(64), lambda i: -100))[1:64] END AS labels, place::INT AS marker_at FROM n""")
def training_tokens(t):
    """Conversations as texts, their ids, attention mask and labels; the response marker counts behind the instruction only, and may begin inside a token."""
    lead = F.when((F.col("role") == "user") & (F.col("turn") % 3 != 2), ASK).when((F.col("role") == "assistant") & (F.col("conv_id") % 4 == 1), "so" + SAY).when(F.col("role") == "assistant", SAY).otherwise("")
    held = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(lead, F.coalesce("text", F.lit(""))).alias("said")))).alias("ms"))
    said = F.transform("ms", lambda m: m["said"])
    texts = _shipped(held).select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.array_join(said, " ")).otherwise(F.array_join(said, "\n")).alias("text"))
    rows = training.training_rows(texts, tokenizers.plain(), 64, markers=(ASK, SAY))
    return rows.select("conv_id", "input_ids", "attention_mask", "labels", training.response_at(F.col("text"), ASK, SAY).alias("marker_at"))


@query("""
WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: (length(x) * 3 - 9)::INT) AS ids FROM documents)
SELECT doc_id, list_transform(list_filter(ids, lambda x: x >= 0), lambda x: least(x, 15)) AS safe, (list_position(ids, list_max(ids)) - 1)::BIGINT AS best, list_filter(ids, lambda x: x <> -100) AS counted,
       (ids || list_transform(range(24), lambda i: 0))[1:24] AS padded FROM w""")
def token_repair(t):
    """D5, D7, D8."""
    docs = t("documents").select("doc_id", F.transform(F.split("text", " "), lambda x: F.length(x) * 3 - 9).alias("ids"))
    ids = F.col("ids")
    return docs.select("doc_id", training.safe_ids(ids, 16).alias("safe"), training.argmax(ids).alias("best"), training.unmasked(ids).alias("counted"), training.padded(ids, 24).alias("padded"))


@query(
    PAIRS
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS n FROM t)
SELECT id, string_agg('<|im_start|>user' || chr(10) || CASE n WHEN 1 THEN 'I''m looking at some financial data. Here''s the context:' || chr(10) || chr(10) || 'none' || chr(10) || chr(10) ELSE '' END || question || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) || '<begin_of_program>' || chr(10) || 'add( ' || gold || ' 1 )  divide( #0 2 ) EOF' || chr(10) || '<end_of_program>' || chr(10) || chr(10) || '<begin_of_answer>' || chr(10) || gold || '.0' || chr(10) || '<end_of_answer>'
  || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered FROM n GROUP BY id"""
)
def sharegpt_build(t):
    """Conversations built and rendered."""
    turns = _judged(t)
    program = F.concat(F.lit("add("), F.col("gold"), F.lit(", 1), divide(#0, 2)"))
    built = training.conversations(turns.select("id", "turn", "question", program.alias("program"), F.concat(F.lit("$"), F.col("gold")).alias("answer"), F.lit("none").alias("context")))
    return built.select("id", text.render(F.col("conversations"), "qwen").alias("rendered"))


@query("""
SELECT doc_id, CASE WHEN doc_id * 2654435761 % 100 < 10 THEN 'eval' ELSE 'train' END AS split FROM documents""")
def split_hash(t):
    """An extension: a split by arithmetic on the id, which both engines know, as ``training.split_of`` (O3) does by xxhash64."""
    return t("documents").select("doc_id", F.when(F.col("doc_id") * F.lit(2654435761) % 100 < 10, "eval").otherwise("train").alias("split"))


@query("""
SELECT i.item_id, CASE WHEN i.item_id % 2 = 0 THEN ['first', 'second part'] ELSE ['plain line'] END AS items, i.item_id % 3 = 0 AS needs, ['revenue', 'net income'] AS metrics,
  CASE i.item_id % 4 WHEN 0 THEN 'qwen' WHEN 1 THEN 'llama-3.1' WHEN 2 THEN 'llama-2' ELSE 'chatml' END AS template, i.item_id % 3 = 0 AS numeric FROM benchmark i""")
def query_parsing(t):
    """Lists, analyses, intents and template names."""
    i = F.col("item_id")
    listed = F.when(i % 2 == 0, F.lit("1. first\n2 second part\n")).otherwise(F.lit("\nplain line\n"))
    analysis = F.concat(F.when(i % 3 == 0, "needs: True\n").otherwise("needs: no\n"), F.lit("financial_metrics: ['revenue', \"net income\", ]\noperations: []"))
    model = F.when(i % 4 == 0, "Qwen2.5-7B").when(i % 4 == 1, "Llama-3.1-8B").when(i % 4 == 2, "mistral").otherwise("other")
    asked = F.when(i % 3 == 0, "Which operations grew?").otherwise("Who wrote it?")
    a = text.query_analysis(analysis)
    return t("benchmark").select("item_id", text.numbered_list(listed).alias("items"), a["needs_numerical_computation"].alias("needs"), a["financial_metrics"].alias("metrics"), text.template_name(model).alias("template"), text.asks_for_numbers(asked).alias("numeric"))


@query("""
SELECT n_regionkey AS id, 'x the total of a is ' || count(*) || ' ; the total of b is ' || max(n_nationkey) || ' ;' AS sentence FROM nation GROUP BY n_regionkey""")
def row_sentences(t):
    """table rows as sentences."""
    n = t("nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.count(F.lit(1)).cast("string").alias("n"), F.max("n_nationkey").cast("string").alias("m"))
    return n.select("id", text.remove_space(text.row_to_text(F.array(F.lit("x"), F.lit("a"), F.lit("b")), F.array(F.lit("total"), F.col("n"), F.col("m")))).alias("sentence"))

PAIRED = """
WITH p AS (SELECT conv_id AS id, turn, text AS question, role, lead(text) OVER w AS reply, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT id, turn, question, length(reply)::VARCHAR AS said, row_number() OVER (PARTITION BY id ORDER BY turn) AS k FROM p WHERE role = 'user' AND next_role = 'assistant'),
h AS (SELECT *, coalesce(string_agg('Q' || k || ': ' || question || chr(10) || 'A' || k || ': ' || said || chr(10) || chr(10), '') OVER (PARTITION BY id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM t)
"""


@query(
    PAIRED
    + """
SELECT id, turn, 'Context:' || chr(10) || 'file ' || id || chr(10) || chr(10) || history || 'Question: ' || question || chr(10) || 'Answer:' AS prompt,
  ['system', 'Only a number.', 'user', 'CONTEXT:' || chr(10) || 'file ' || id || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'PREVIOUS CONVERSATION:' || chr(10) || history] AS chat FROM h"""
)
def prompts(t):
    """The plain prompt and the two messages of the chat prompt, with all earlier turns."""
    turns = dialogue.paired_turns(t("conversations")).withColumn("predicted", F.length("reply").cast("string"))
    context = F.concat(F.lit("file "), F.col("id").cast("string"))
    chat = text.chat_prompt(context, F.col("history"), F.col("question"), "Only a number.")
    return dialogue.with_history(turns).select("id", "turn", text.prompt(context, F.col("history"), F.col("question")).alias("prompt"), F.flatten(F.transform(chat, lambda m: F.array(m["role"], m["content"]))).alias("chat"))


@query("""
WITH d AS (SELECT doc_id, n_chars, CASE WHEN ('0x' || substr(md5(doc_id || ':7'), 1, 8))::BIGINT % 100 < 20 THEN 'eval' ELSE 'train' END AS split FROM documents)
SELECT * FROM (SELECT * FROM d WHERE split = 'train' ORDER BY n_chars DESC, doc_id LIMIT 100) UNION ALL SELECT * FROM (SELECT * FROM d WHERE split = 'eval' ORDER BY doc_id LIMIT 40)""")
def split_limits(t):
    """O3: a seeded split, and the most examples of each part, by a total order."""
    docs = t("documents").select("doc_id", "n_chars", training.split_of(F.col("doc_id"), 20, 7).alias("split"))
    return training.first_rows(docs.where("split = 'train'").withColumn("less", -F.col("n_chars")), 100, "less", "doc_id").drop("less").union(training.first_rows(docs.where("split = 'eval'"), 40, "doc_id"))


@query("""
WITH c AS (SELECT o_custkey AS id, o_orderkey AS turn, (o_orderkey % 97)::VARCHAR AS a FROM orders WHERE o_orderkey % 7 = o_custkey % 7),
m AS (SELECT id, turn, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY turn) = 1 THEN 'I''m looking at some financial data. Here''s the context:' || chr(10) || chr(10) || 'of ' || id || chr(10) || chr(10) ELSE '' END || 'what of ' || turn || '?' AS asked,
  '<begin_of_program>' || chr(10) || 'add( ' || a || ' 1 ) EOF' || chr(10) || '<end_of_program>' || chr(10) || chr(10) || '<begin_of_answer>' || chr(10) || a || '.0' || chr(10) || '<end_of_answer>' AS said FROM c)
SELECT id, flatten(list([asked, said] ORDER BY turn)) AS messages, 'You decide which tools answer a question on financial data. These are the tools:' || chr(10) || '- add: add( number1 number2 ) EOF' || chr(10) || '- subtract: subtract( number1 number2 ) EOF' || chr(10)
  || '- multiply: multiply( number1 number2 ) EOF' || chr(10) || '- divide: divide( number1 number2 ) EOF' || chr(10) || chr(10) || 'Answer in this form and with nothing else:' || chr(10) || '<begin_of_program>' || chr(10) || 'operation( number1 number2 ) EOF' || chr(10) || '<end_of_program>' || chr(10) || chr(10)
  || '<begin_of_answer>' || chr(10) || 'number' || chr(10) || '<end_of_answer>' || chr(10) || chr(10) || '#0, #1 and so on stand for the results of earlier calls. Every program ends with EOF.' || chr(10) AS system FROM m GROUP BY id""")
def calling_build(t):
    """Training conversations of the function-calling variant."""
    a = (F.col("o_orderkey") % 97).cast("string")
    rows = t("orders").where("o_orderkey % 7 = o_custkey % 7").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("turn"), F.concat(F.lit("what of "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("question"), F.concat(F.lit("add("), a, F.lit(", 1)")).alias("program"), F.concat(F.lit("$"), a).alias("answer"), F.concat(F.lit("of "), F.col("o_custkey").cast("string")).alias("context"))
    built = training.conversations(rows, training.calling_rules())
    return built.select("id", F.transform("conversations", lambda m: m["content"]).alias("messages"), "system")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::INT::VARCHAR AS a, l_linenumber::VARCHAR AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
s AS (SELECT *, 'paid $' || a || ' million, ' || n || ' % off and ' || n || '%% of 2,500 thousand in all, yet ' || n || ' - million' AS said, 16 + length(a) AS p2, 26 + length(a || n) AS p3 FROM b),
p AS (SELECT *, p3 + length(n) + 6 AS p4, greatest(0, p3 - 30) AS since FROM s)
SELECT l_orderkey, l_linenumber, i, said, [a::DOUBLE, n::DOUBLE, n::DOUBLE / 100, 2500.0, n::DOUBLE * 1e6] AS values, [true, false, false, false, false] AS currency, [false, false, true, false, false] AS percentage,
  [5, p2, p3, p4, p4 + 27]::INT[] AS places, trim(substr(said, since + 1, p3 + length(n) + 2 + 30 - since)) AS third FROM p""")
def number_units(t):
    """What each number of a sentence is: a unit counts behind a match, not in it, as a percent sign does; blanks before a number are part of it."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    a, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    said = F.concat(F.lit("paid $"), a, F.lit(" million, "), n, F.lit(" % off and "), n, F.lit("%% of 2,500 thousand in all, yet "), n, F.lit(" - million"))
    rows = _shipped(t("lineitem")).select("l_orderkey", "l_linenumber", "l_quantity", F.row_number().over(order).cast("long").alias("i"))  # texts are made behind the sort
    rows = rows.select("l_orderkey", "l_linenumber", "i", said.alias("said")).withColumn("found", numbers.all_numbers(F.col("said")))
    of = lambda c: F.transform("found", lambda x: x[c])
    return rows.select("l_orderkey", "l_linenumber", "i", "said", of("value").alias("values"), of("is_currency").alias("currency"), of("is_percentage").alias("percentage"), of("position").alias("places"), F.get(of("context"), F.lit(2)).alias("third"))


@query("""
WITH b AS (SELECT o_orderkey AS id, (o_custkey % 1000) AS x, (o_orderkey % 77) AS y, o_orderkey % 8 AS k, (o_orderkey // 8) % 4 AS f FROM orders),
c AS (SELECT *, x::VARCHAR AS a, y::VARCHAR AS c, f = 2 AS llama, f = 3 AS gemma FROM b),
e AS (SELECT *, 'add( ' || a || ' ' || c || ' ) EOF' AS pr, (x + y) || '.0' AS total FROM c),
r AS (SELECT *, CASE k WHEN 0 THEN [pr, a] WHEN 1 THEN [pr, total] WHEN 2 THEN CASE WHEN llama THEN [pr, '7'] WHEN gemma THEN [a || ' + ' || c || ' = 7 here'] ELSE ['we get ' || a || ' + ' || c || ' = 7 here'] END
    WHEN 3 THEN CASE WHEN llama THEN [pr, '99'] ELSE ['values ' || a || ', ' || c || ', 99 only'] END WHEN 4 THEN ['subtract( ' || a || ' ' || c || ' ) EOF', c]
    WHEN 5 THEN CASE WHEN llama THEN ['add( 12 ' || a || ' ) EOF', c] ELSE ['system: add things user: multiply 12 by ' || a || ' and ' || c || ' EOF'] END WHEN 6 THEN [pr, total] ELSE ['divide( ' || a || ' 0 ) gives nothing'] END AS rescued,
  CASE k WHEN 0 THEN [pr, a] WHEN 1 THEN [pr, a] WHEN 2 THEN ['EOF', a] WHEN 3 THEN ['EOF', a] WHEN 4 THEN ['subtract( ' || a || ' ' || c || ' ) EOF', c] WHEN 5 THEN ['add( 12 ' || a || ' ) EOF', (12 + x) || '.0'] WHEN 6 THEN [pr, c] ELSE ['divide( ' || a || ' 0 ) EOF', a] END AS cleaned FROM e)
SELECT id, CASE WHEN len(rescued) = 1 THEN rescued[1] ELSE '<begin_of_program>' || chr(10) || rescued[1] || chr(10) || '<end_of_program>' || chr(10) || chr(10) || '<begin_of_answer>' || chr(10) || rescued[2] || chr(10) || '<end_of_answer>' END AS rescued,
  '<begin_of_program>' || chr(10) || cleaned[1] || chr(10) || '<end_of_program>' || chr(10) || chr(10) || '<begin_of_answer>' || chr(10) || cleaned[2] || chr(10) || '<end_of_answer>' AS cleaned FROM r""")
def rescue_families(t):
    """Outputs of eight kinds by four families of models: tags, turns, operations, equations, lone numbers, repeated prompts."""
    k, a, c = F.col("o_orderkey") % 8, (F.col("o_custkey") % 1000).cast("string"), (F.col("o_orderkey") % 77).cast("string")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    said = (
        F.when(k == 0, put("x <begin_of_program> add( ", a, " ", c, " ) EOF <end_of_program> y <begin_of_answer> ", a, " <end_of_answer> z"))
        .when(k == 1, put("so add( ", a, " ", c, " ) it is")).when(k == 2, put("we get ", a, " + ", c, " = 7 here")).when(k == 3, put("values ", a, ", ", c, ", 99 only"))
        .when(k == 4, put("<|im_start|>user\nhow<|im_end|>\n<|im_start|>assistant\n<begin_of_program>subtract( ", a, " ", c, " ) EOF<end_of_program><begin_of_answer>", c, "<end_of_answer><|im_end|>"))
        .when(k == 5, put("system: add things user: multiply 12 by ", a, " and ", c, " EOF"))
        .when(k == 6, put("system user <begin_of_program>none<end_of_program> add( ", a, " ", c, " ) EOF <begin_of_answer>", c, "<end_of_answer>")).otherwise(put("divide( ", a, " 0 ) gives nothing"))
    )
    family = F.element_at(F.array(*map(F.lit, ("", "qwen", "llama-3.3", "gemma-3"))), (F.floor(F.col("o_orderkey") / 8) % 4 + 1).cast("int"))
    return _shipped(t("orders")).select(F.col("o_orderkey").alias("id"), outputs.rescue_of(said, family, F.lit("we get ")).alias("rescued"), outputs.clean_of(said).alias("cleaned"))


@query("""
WITH b AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k FROM orders)
SELECT id, k IN (0, 3, 4, 5, 6, 7) AS program_match, k NOT IN (3, 6) AS answer_match FROM b""")
def prediction_pairs(t):
    """Programs that differ, are spaced otherwise or half tagged; answers that are equal, near, alike in words, of another type, or wrong."""
    return predictions.with_matches(_shipped(_pairs(t))).select("id", "program_match", "answer_match")


@query("""
WITH b AS (SELECT o_orderkey % 8 AS k FROM orders)
SELECT count(*) FILTER (k IN (0, 3, 4, 5, 6, 7)) / count(*)::DOUBLE * 100 AS program_match, count(*) FILTER (k NOT IN (3, 6)) / count(*)::DOUBLE * 100 AS answer_match FROM b""")
def prediction_rates(t):
    """The shares of both matches among predictions of all kinds."""
    return predictions.match_rates(predictions.with_matches(_shipped(_pairs(t))))


def _pairs(t) -> DataFrame:
    k, v = F.col("o_orderkey") % 8, (F.col("o_custkey") % 500 + 1000).cast("string")
    answer = lambda x: F.concat(F.lit("<begin_of_answer> "), x, F.lit(" <end_of_answer>"))
    both = lambda p, x: F.concat(F.lit("<begin_of_program>"), p, F.lit("<end_of_program>"), answer(x))
    add = F.concat(F.lit(" add( "), v, F.lit(" 1 ) EOF "))
    pred = (
        F.when(k == 1, both(F.concat(F.lit("add( 1 "), v, F.lit(" ) EOF")), v)).when(k == 2, F.concat(F.lit("<begin_of_program>"), add, answer(v))).when(k == 3, answer((F.col("o_custkey") % 500 + 1100).cast("string")))
        .when(k == 4, both(F.concat(F.lit("\n add(   "), v, F.lit("\t1 )  EOF")), (F.col("o_custkey") % 500 + 1005).cast("string"))).when(k == 5, answer(F.lit("Increase of all sales"))).when(k == 6, answer(F.lit("nothing at all")))
        .when(k == 7, answer(F.concat(F.lit("about "), v))).otherwise(both(add, v))
    )
    label = F.when(k.isin(3, 7), answer(v)).when(k == 5, answer(F.lit("increases of all sale"))).when(k == 6, answer(F.lit("a great deal"))).otherwise(both(add, v))
    return t("orders").select(F.col("o_orderkey").alias("id"), pred.alias("pred"), label.alias("label"))


@query("""
WITH b AS (SELECT o_orderkey AS id, (o_custkey % 1000)::VARCHAR AS a, o_orderkey % 12 AS k FROM orders)
SELECT id, CASE WHEN k = 11 THEN 'N/A' WHEN k = 3 THEN '-' || a || '.5' WHEN k = 8 THEN '77' ELSE a END AS answer FROM b""")
def answer_places(t):
    """an answer in each place that no earlier one covers, after an empty place, in the last turn of a chat, or none."""
    k, a = F.col("o_orderkey") % 12, (F.col("o_custkey") % 1000).cast("string")
    said = {
        0: ("so the result is ", a, " now"), 1: ("it has x = ", a, " and 5 more"), 2: ("it cost $", a, " of 9 dollars"), 3: ("therefore, -", a, ".5 of 3 it is"), 4: ("12 words.\n", a, "\nand 4 more"),
        5: ("of 3 there are ", a), 6: ("the answer is unclear, 4 of them = ", a, " then 5"), 7: ("3 and then ", a, " of them"), 8: ("<begin_of_answer>And<end_of_answer> ", a, " then 77 of it"), 9: ("result: 3 <begin_of_answer> ", a, " <end_of_answer>"),
        10: ("<|im_start|>user\nanswer is 3<|im_end|>\n<|im_start|>assistant\nThe value: ", a, "<|im_end|>"), 11: ("no figure",),
    }
    whole = F.lit("")
    for n, parts in said.items():
        whole = F.when(k == n, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise(whole)
    return t("orders").select(F.col("o_orderkey").alias("id"), text.robust_answer(whole).alias("answer"))


@query("""
SELECT item_id, item_id % 2 = 0 AS needs, ['revenue 2008', 'cost'] AS to_extract, CASE WHEN item_id % 3 = 0 THEN ['add', 'divide'] ELSE [] END AS operations, ['2008', item_id::VARCHAR] AS periods, ['net income'] AS metrics FROM benchmark""")
def analysis_lists(t):
    """the flag and all four lists of an analysis, quoted, empty or over lines."""
    i = F.col("item_id")
    said = F.concat(
        F.when(i % 2 == 0, "Needs numerical computation: TRUE\n").otherwise("no\n"), F.lit("Values_to_Extract: ['revenue 2008', \"cost\"]\noperations: "), F.when(i % 3 == 0, "[add,\n divide]").otherwise("[]"),
        F.lit("\ntime_periods [2008, '"), i.cast("string"), F.lit("']\nfinancial_metrics: [ 'net income' , ]"),
    )
    a = text.query_analysis(said)
    return t("benchmark").select("item_id", a["needs_numerical_computation"].alias("needs"), a["values_to_extract"].alias("to_extract"), a["operations"].alias("operations"), a["time_periods"].alias("periods"), a["financial_metrics"].alias("metrics"))


@query("""
SELECT item_id, ['<answer>$206,588</answer>', '<answer>$181,001</answer>', '<answer>25,587</answer>', '<answer>14.1%</answer>', '<answer>1,314</answer>', '<answer>1,194</answer>', '<answer>120</answer>', '<answer>10.1%</answer>',
  '<answer>Unable to find answer in context</answer>', '<answer>Unable to find answer in context</answer>'][item_id % 10 + 1] AS response FROM benchmark""")
def mock_rules(t):
    """Each rule of the mock, and questions that fit none, one for want of the right question before."""
    asked = [
        ("Cash from operating activities in 2009?", "x"), ("cash flow of Operating Activities, 2008", None), ("and the difference?", "cash of 2008"), ("what percentage?", "the difference"), ("Operating income of 2011", None),
        ("operating income of 2010", "x"), ("the difference then?", "operating income"), ("as a percentage increase?", "operating income of 2010"), ("what percentage?", "cash"), ("who?", "the difference"),
    ]
    pick = lambda n: F.element_at(F.array(*(F.lit(x[n]).cast("string") for x in asked)), (F.col("item_id") % len(asked) + 1).cast("int"))
    return t("benchmark").select("item_id", dialogue.mock_response(pick(0), pick(1)).alias("response"))


# --- question answering ----------------------------------------------------------------------------------------------

ASKED = """
WITH q AS (SELECT item_id AS query_id, replace(text, chr(10), ' ') AS query FROM benchmark),
x AS (SELECT query_id, -1 AS variant, query FROM q UNION ALL SELECT query_id, 0, trim(regexp_replace(lower(query), '^\\s+|\\s+$', '', 'g')) FROM q UNION ALL SELECT query_id, 1, 'z' || regexp_replace(query, '[aeiou]', '', 'g') || 'z' FROM q),
ls AS (SELECT string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ') AS l),
qv AS (SELECT query_id, variant, list_transform(l, lambda c: (length(lower(query)) - length(replace(lower(query), c, '')))::DOUBLE) AS e FROM x, ls),
nv AS (SELECT doc_id AS node_id, contains(coalesce(text, ''), '|') AS is_table, list_transform(l, lambda c: (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), c, '')))::DOUBLE) AS e FROM documents, ls),
s AS (SELECT query_id, variant, node_id, is_table, list_cosine_similarity(qv.e, nv.e) AS score FROM qv, nv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant, is_table ORDER BY round(score, 9) DESC, node_id) AS n FROM s WHERE isfinite(score))
""".replace("\\\\", "\\")


@query(ASKED + "SELECT query_id, node_id, round(max(score), 6) AS score, min((variant + 1) * 10 + CASE WHEN is_table THEN 5 ELSE 0 END + n)::BIGINT AS seq FROM r WHERE n <= 5 GROUP BY query_id, node_id")
def query_variants(t):
    """Questions, and the variants that a provider lists, against documents by letter counts."""
    queries = _shipped(t("benchmark")).select(F.col("item_id").alias("query_id"), F.translate("text", "\n", " ").alias("query"))
    listed = lambda p: F.concat(F.lit("1. "), F.lower(F.replace(p, F.lit(engine.EXPAND), F.lit(""))), F.lit("\n2. z"), F.regexp_replace(F.replace(p, F.lit(engine.EXPAND), F.lit("")), "[aeiou]", ""), F.lit("z"))
    variants = engine.expanded(queries, listed)
    nodes = retrieval.embedded(t("documents"), "text").select(F.col("doc_id").alias("node_id"), F.coalesce(F.col("text").contains("|"), F.lit(False)).alias("is_table"), "vec")
    hits = engine.multi_query_hits(queries, variants, engine.vector_search(nodes, retrieval.letter_counts))
    return hits.select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("seq").cast("long").alias("seq"))


HASHED = "list_transform(regexp_extract_all(lower({}), '[^\\s]+'), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 262144)"


@query(f"""
WITH q AS (SELECT item_id AS query_id, replace(text, chr(10), ' ') AS query FROM benchmark),
x AS (SELECT query_id, -1 AS variant, query FROM q UNION ALL SELECT query_id, 0, string_agg(w, ' ' ORDER BY i) FROM (SELECT query_id, unnest(string_split(query, ' ')) AS w, generate_subscripts(string_split(query, ' '), 1) AS i FROM q) WHERE i <= 5 GROUP BY query_id),
dt AS (SELECT doc_id, is_table, b, count(*) AS n FROM (SELECT doc_id, contains(coalesce(text, ''), '|') AS is_table, unnest({HASHED.format("text")}) AS b FROM documents) GROUP BY ALL),
wt AS (SELECT b, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) AS w FROM dt GROUP BY b),
dw AS (SELECT doc_id, is_table, b, n * w / sqrt(sum((n * w) ** 2) OVER (PARTITION BY doc_id)) AS w FROM dt JOIN wt USING (b) WHERE w > 0),
qt AS (SELECT query_id, variant, b, count(*) AS n FROM (SELECT query_id, variant, unnest({HASHED.format("query")}) AS b FROM x) GROUP BY ALL),
qu AS (SELECT query_id, variant, b, n * coalesce(w, (SELECT ln(1 + count(*)::DOUBLE) FROM documents)) AS w FROM qt LEFT JOIN wt USING (b) WHERE coalesce(w, 1) > 0),
qw AS (SELECT query_id, variant, b, w / sqrt(sum(w ** 2) OVER (PARTITION BY query_id, variant)) AS w FROM qu),
s AS (SELECT query_id, variant, doc_id AS node_id, is_table, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (b) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant, is_table ORDER BY round(score, 9) DESC, node_id) AS n FROM s WHERE score > 0)
SELECT query_id, node_id, round(max(score), 6) AS score, min((variant + 1) * 10 + CASE WHEN is_table THEN 5 ELSE 0 END + n)::BIGINT AS seq FROM r WHERE n <= 5 GROUP BY query_id, node_id""")
def query_terms(t):
    """Questions and their first five words against documents, by hashed terms weighted on all documents."""
    queries = _shipped(t("benchmark")).select(F.col("item_id").alias("query_id"), F.translate("text", "\n", " ").alias("query"))
    variants = queries.select("query_id", F.lit(0).alias("variant"), F.substring_index("query", " ", 5).alias("query"))
    nodes = t("documents").select(F.col("doc_id").alias("node_id"), F.coalesce(F.col("text").contains("|"), F.lit(False)).alias("is_table"), F.col("text").alias("content"))
    hits = engine.multi_query_hits(queries, variants, terms.term_search(terms.fit(t("documents")), nodes))
    return hits.select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("seq").cast("long").alias("seq"))


@query(VECTORS + "SELECT query_id, node_id, s::INT + CASE WHEN is_table THEN 10 ELSE 0 END AS place FROM a WHERE s <= 10")
def numeric_nodes(t):
    """Ten texts and ten tables for a query."""
    return engine.numeric_nodes(_hits(t, 10)).select("query_id", "node_id", "place")


@query("""
WITH q AS (SELECT item_id AS query_id, replace(text, chr(10), ' ') AS query, item_id % 3 AS n FROM benchmark),
a AS (SELECT query_id, query, n, 'ctext_search' || chr(10) || chr(10) || 'who is ' || query_id || '?' AS p1, 'ctable_search' || chr(10) || chr(10) || 'what total has ' || query_id || '?' AS p2 FROM q),
f AS (SELECT *, 'Based on the following information:' || chr(10) || chr(10) || 'Question 1: who is ' || query_id || '?' || chr(10) || 'Answer 1: r' || length(p1) || chr(10) || chr(10)
  || 'Question 2: what total has ' || query_id || '?' || chr(10) || 'Answer 2: r' || length(p2) || chr(10) || chr(10) || 'Please answer the original question: ' || query AS final FROM a),
d AS (SELECT *, 'c' || CASE WHEN regexp_matches(lower(query), 'table|row|column|total|how much|how many|percent|[0-9]{4}') THEN 'table_search' ELSE 'text_search' END || chr(10) || chr(10) || query AS plain FROM f)
SELECT query_id, CASE WHEN n = 0 THEN 'r' || length(plain) ELSE 'r' || length(final) END AS response, CASE WHEN n = 0 THEN 0 ELSE 2 END AS n_parts,
  CASE WHEN n <> 0 THEN 'r' || length(p2) END AS second FROM d""")
def sub_questions(t):
    """The assembly alone, contexts being the tools' names: a third of the questions is answered directly, the others by way of two."""
    queries = _shipped(t("benchmark")).select(F.col("item_id").alias("query_id"), F.translate("text", "\n", " ").alias("query"), (F.col("item_id") % 3).alias("n"))
    marked = queries.select("query_id", F.concat(F.col("n").cast("string"), F.lit("#"), F.col("query_id").cast("string"), F.lit("#"), F.col("query")).alias("query"))
    said = lambda p: F.replace(p, F.lit(engine.SPLIT), F.lit(""))
    key = lambda p: F.element_at(F.split(said(p), "#"), 2)
    split = lambda p: F.when(said(p).startswith("0#"), said(p)).otherwise(F.concat(F.lit("1. who is "), key(p), F.lit("?\n2. what total has "), key(p), F.lit("?")))
    find = lambda df: df.withColumn("context", F.concat(F.lit("c"), F.col("tool")))
    respond = lambda p: F.concat(F.lit("r"), F.length(F.regexp_replace(p, r"[0-2]#\d+#", "")).cast("string"))
    out = engine.sub_question_engine(marked, split, find, respond)
    return out.select("query_id", "response", F.size("sub_questions").alias("n_parts"), F.get("sub_questions", F.lit(1))["response"].alias("second"))


NEAR = """
ls AS (SELECT string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ') AS l),
qv AS (SELECT query_id, no, list_transform(l, lambda c: (length(lower(question)) - length(replace(lower(question), c, '')))::DOUBLE) AS e FROM t, ls),
nv AS (SELECT doc_id AS node_id, coalesce(text, '') AS content, contains(coalesce(text, ''), '|') AS is_table, list_transform(l, lambda c: (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), c, '')))::DOUBLE) AS e FROM documents, ls),
s AS (SELECT query_id, no, node_id, is_table, list_cosine_similarity(qv.e, nv.e) AS score FROM qv, nv WHERE isfinite(list_cosine_similarity(qv.e, nv.e))),
"""


def _document_nodes(t) -> DataFrame:
    """Documents as nodes; a bar makes a table, a figure a text with numbers."""
    said = F.coalesce("text", F.lit(""))
    return retrieval.embedded(t("documents"), "text").select(F.col("doc_id").alias("node_id"), said.contains("|").alias("is_table"), said.rlike("[0-9]").alias("has_numbers"), F.col("source").alias("source"), "vec", said.alias("content"))


def _benchmark_questions(t) -> DataFrame:
    return _shipped(t("benchmark")).select(F.col("item_id").alias("query_id"), text.strip(F.translate("text", "\n", " ")).alias("query"))


BENCHMARK_QUESTIONS = "SELECT item_id AS query_id, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS query FROM benchmark"


@query(
    f"""
WITH q AS ({BENCHMARK_QUESTIONS}),
p AS (
  SELECT query_id, query, -1 AS no, query AS question FROM q WHERE length(query) % 3 = 0 UNION ALL SELECT query_id, query, 0, 'who said ' || query FROM q WHERE length(query) % 3 <> 0
  UNION ALL SELECT query_id, query, 1, 'what total has ' || query FROM q WHERE length(query) % 3 <> 0 UNION ALL SELECT query_id, query, 2, 'background of ' || query FROM q WHERE length(query) % 3 <> 0),
t AS (SELECT *, CASE WHEN starts_with(question, 'background of') THEN 'context' WHEN regexp_matches(lower(question), 'table|row|column|total|how much|how many|percent|[0-9]{{4}}') THEN 'table' ELSE 'text' END AS tool FROM p),
{NEAR}
r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id, no ORDER BY round(score, 9) DESC, node_id) AS n FROM s JOIN t USING (query_id, no) WHERE tool = 'context' OR is_table = (tool = 'table')),
x AS (SELECT query_id, no, string_agg(content, chr(10) || chr(10) ORDER BY n) AS context FROM r JOIN nv USING (node_id) WHERE n <= 3 GROUP BY ALL),
a AS (SELECT t.*, md5(coalesce(context, '') || chr(10) || chr(10) || question) AS response FROM t LEFT JOIN x USING (query_id, no)),
f AS (
  SELECT query_id, md5('Based on the following information:' || chr(10) || chr(10) || string_agg('Question ' || no + 1 || ': ' || question || chr(10) || 'Answer ' || no + 1 || ': ' || response || chr(10) || chr(10), '' ORDER BY no)
    || 'Please answer the original question: ' || any_value(query)) AS response, list(response ORDER BY no) AS parts FROM a WHERE no >= 0 GROUP BY query_id)
SELECT query_id, response, parts FROM f UNION ALL SELECT query_id, response, []::VARCHAR[] FROM a WHERE no < 0"""
)
def sub_question_search(t):
    """Sub-questions go to the text, table and context tools, whose nearest documents are their contexts; one search serves all."""
    split = lambda p: F.when(F.length(_behind(p, engine.SPLIT)) % 3 == 0, _behind(p, engine.SPLIT)).otherwise(F.concat(F.lit("1. who said "), _behind(p, engine.SPLIT), F.lit("\n2. what total has "), _behind(p, engine.SPLIT), F.lit("\n3. background of "), _behind(p, engine.SPLIT)))
    choose = lambda p: F.when(F.substring_index(p, "\nQuestion: ", -1).startswith("background of"), "The context_search tool.").otherwise("Any.")
    out = engine.sub_question_engine(_benchmark_questions(t), split, engine.tool_search(_document_nodes(t), retrieval.letter_counts, 3), F.md5, choose)
    return out.select("query_id", "response", F.transform("sub_questions", lambda q: q["response"]).alias("parts"))


def _behind(prompt, opening: str):
    """What a prompt asks about."""
    return F.replace(prompt, F.lit(opening), F.lit(""))


@query(
    f"""
WITH q AS (SELECT *, length(query) % 2 = 0 AND regexp_matches(lower(query), '{text.NUMERIC_TERMS}') AS numeric FROM (SELECT query_id, CASE WHEN query_id % 4 < 3 THEN 'what total of ' ELSE '' END || query AS query FROM ({BENCHMARK_QUESTIONS}))),
t AS (
  SELECT query_id, -1 AS no, 'about ' || query AS question FROM q UNION ALL SELECT query_id, 0, lower('about ' || query) FROM q
  UNION ALL SELECT query_id, 1, 'z' || regexp_replace('about ' || query, '[aeiou]', '', 'g') || 'z' FROM q),
{NEAR}
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, no, is_table ORDER BY round(score, 9) DESC, node_id) AS n, row_number() OVER (PARTITION BY query_id, no ORDER BY round(score, 9) DESC, node_id) AS nc FROM s),
u AS (SELECT query_id, node_id, max(score) AS score, min((no + 1) * 10 + is_table::INT * 5 + n) AS seq FROM r WHERE n <= 5 GROUP BY ALL),
kept AS (SELECT query_id, node_id, 0 AS part, seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq, node_id) AS m FROM u WHERE score >= 0.7) WHERE m <= 3),
tx AS (SELECT query_id, node_id, 1 AS part, n AS seq FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY r.n, r.node_id) AS m FROM r ANTI JOIN kept USING (query_id, node_id) WHERE no = -1 AND is_table AND n <= 5) WHERE m <= 2),
cx AS (SELECT query_id, node_id, 2 AS part, nc AS seq FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY r.nc, r.node_id) AS m FROM r ANTI JOIN u USING (query_id, node_id) WHERE no = -1 AND nc <= 5) WHERE m <= 2),
f AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY part, seq, node_id) AS seq FROM (SELECT * FROM kept UNION ALL SELECT * FROM tx UNION ALL SELECT * FROM cx)),
b AS (SELECT f.*, is_table OR regexp_matches(content, '[0-9]') AS num FROM f JOIN nv USING (node_id) JOIN q USING (query_id) WHERE numeric),
c AS (SELECT query_id, count(*) FILTER (num) AS nn FROM b GROUP BY query_id),
e AS (SELECT r.query_id, r.node_id, r.n, c.nn, row_number() OVER (PARTITION BY r.query_id ORDER BY r.n, r.node_id) AS m FROM r ANTI JOIN (SELECT * FROM b WHERE num) b USING (query_id, node_id) JOIN c ON c.query_id = r.query_id AND c.nn < 3 WHERE no = -1 AND is_table AND n <= 10),
o AS (
  SELECT f.* FROM f JOIN q USING (query_id) WHERE NOT numeric UNION ALL SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY part, seq, node_id) AS seq
  FROM (SELECT query_id, node_id, CASE WHEN num THEN 0 ELSE 2 END AS part, seq FROM b UNION ALL SELECT query_id, node_id, 1, n FROM e WHERE m <= 5 - nn)),
x AS (SELECT query_id, list(node_id ORDER BY seq) AS nodes, string_agg(content, chr(10) || chr(10) ORDER BY seq) AS context FROM o JOIN nv USING (node_id) GROUP BY query_id)
SELECT query_id, 'about ' || query AS searched, numeric, coalesce(nodes, []) AS nodes, md5(coalesce(context, '') || chr(10) || chr(10) || query) AS response, numeric AS computed,
  CASE WHEN numeric THEN ['Time period comparison requested: 2008, 2009'] END AS steps FROM q LEFT JOIN x USING (query_id)"""
)
def question_answers(t):
    """From questions to responses, numeric and plain ones, by way of one search."""
    rewrite = lambda p: F.concat(F.lit("about "), _behind(p, engine.REWRITE))
    expand = lambda p: F.concat(F.lit("1. "), F.lower(_behind(p, engine.EXPAND)), F.lit("\n2. z"), F.regexp_replace(_behind(p, engine.EXPAND), "[aeiou]", ""), F.lit("z"))
    analyse = lambda p: F.concat(F.when(F.length(_behind(p, engine.ANALYSE)) % 2 == 0, "true").otherwise("no"), F.lit("\ntime_periods: ['2008', '2009']"))
    nodes = _document_nodes(t)
    asked = _benchmark_questions(t).withColumn("query", F.concat(F.when(F.col("query_id") % 4 < 3, "what total of ").otherwise(""), F.col("query")))
    out = engine.answer_questions(asked, nodes, engine.vector_search(nodes, retrieval.letter_counts), F.md5, rewrite, expand, analyse)
    return out.select("query_id", "searched", "numeric", "nodes", "response", F.col("numeric_response").isNotNull().alias("computed"), "steps")


@query("""
WITH g AS (SELECT l_orderkey AS query_id, count(*) AS n_nodes, avg(l_quantity * 1e6) AS mean, median(l_quantity * 1e6) AS median, min(l_quantity * 1e6) AS min, max(l_quantity * 1e6) AS max FROM lineitem GROUP BY 1)
SELECT query_id, n_nodes::INT AS n_metrics, mean, median, min, max, ['Calculated statistics for total revenue', 'Time period comparison requested: 2008, 2009'] AS steps, query_id % 2 = 0 AS asked FROM g""")
def numeric_operations(t):
    """The lines of an order as the nodes of a query."""
    lines = _shipped(t("lineitem"))
    rows = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").agg(F.count(F.lit(1)).alias("c")).select("*", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("i"))  # dealt once, by query
    said = F.concat(F.lit("total revenue was $"), F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.lit(" million"))
    nodes = rows.select(F.col("l_orderkey").alias("query_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "i").alias("place"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "i").alias("node_id"), F.lit("s").alias("source"), F.lit(False).alias("is_table"), said.alias("content"))
    analysis = F.concat(F.when(F.col("query_id") % 2 == 0, "true\n").otherwise("no\n"), F.lit("financial_metrics: ['total revenue', 'other']\ntime_periods: ['2008', '2009']"))
    analyses = lines.select(F.col("l_orderkey").alias("query_id")).distinct().select("query_id", F.lit("how much?").alias("query"), text.query_analysis(analysis).alias("analysis"))
    out = engine.numeric_operations(nodes, analyses, lambda p: F.lit(" done "))
    got = lambda k: F.element_at("computed", F.lit(f"total revenue_{k}")).alias(k)
    return out.select("query_id", F.size("extracted_metrics").alias("n_metrics"), got("mean"), got("median"), got("min"), got("max"), "steps", (F.coalesce("response", F.lit("")) == "done").alias("asked"))


@query("""
WITH b AS (SELECT o_orderkey AS id, (o_custkey % 1000)::VARCHAR AS a, o_orderkey % 3 AS k FROM orders)
SELECT id, CASE k WHEN 2 THEN 'EOF' ELSE 'add( ' || a || ' 1 ) EOF' END AS program, CASE k WHEN 0 THEN a WHEN 1 THEN 'N/A' ELSE a END AS answer,
  length('<s>[INST] <<SYS>>' || chr(10) || 'Only tags.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || CASE WHEN k = 0 THEN '' ELSE 'I''m looking at some financial data. Here''s the context:' || chr(10) || chr(10) || 'ctx' || chr(10) || chr(10) END || 'What of ' || a || '? [/INST]')::INT AS prompt_length FROM b""")
def generation(t):
    """Prompts for an instruction model, and programs and answers out of what repeats them."""
    k, a = F.col("o_orderkey") % 3, (F.col("o_custkey") % 1000).cast("string")
    rows = t("orders").select(F.col("o_orderkey").alias("id"), k.alias("k"), a.alias("a"), F.concat(F.lit("What of "), a, F.lit("?")).alias("question"), F.when(k != 0, "ctx").alias("context"))
    program, answer = F.concat(F.lit("<begin_of_program>add( "), F.col("a"), F.lit(" 1 ) EOF<end_of_program>")), F.concat(F.lit(" x <begin_of_answer> "), F.col("a"), F.lit("<end_of_answer>"))
    said = F.when(F.col("k") == 0, F.concat(program, answer)).when(F.col("k") == 1, program).otherwise(answer)
    out = engine.generated(rows.withColumn("said", said), lambda p: F.concat(p, F.lit("\n"), F.col("said")), "Only tags.")
    return out.select("id", "program", "answer", F.length(text.instruct_prompt(F.col("question"), F.col("context"), "Only tags.")).alias("prompt_length"))


@query("""
WITH b AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, (o_custkey % 1000) AS v FROM orders)
SELECT id, CASE k WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN 0 WHEN 4 THEN v WHEN 5 THEN v END::DOUBLE AS num, CASE k WHEN 3 THEN 'none said' END AS str,
  CASE k WHEN 0 THEN ['EOF'] WHEN 1 THEN ['add(', '1', ')'] ELSE ['EOF'] END AS words,
  CASE k WHEN 1 THEN v::VARCHAR || '%' WHEN 4 THEN v::VARCHAR WHEN 5 THEN v::VARCHAR || '.5' ELSE 'No explicit answer found' END AS shown FROM b""")
def training_answers(t):
    """tags, chat turns, phrases and the lone "and" of one model family."""
    k, v = F.col("o_orderkey") % 6, (F.col("o_custkey") % 1000).cast("string")
    turn = lambda x: F.concat(F.lit("<|im_start|>user\nhow?<|im_end|>\n<|im_start|>assistant\n"), x, F.lit("<|im_end|>"))
    said = (
        F.when(k == 0, turn(F.concat(F.lit("about "), v, F.lit(" or so")))).when(k == 1, F.concat(F.lit("<begin_of_program> add( 1 ) <end_of_program><begin_of_answer> "), v, F.lit("% <end_of_answer>")))
        .when(k == 2, F.lit(" And ")).when(k == 3, turn(F.lit("None said"))).when(k == 4, F.concat(F.lit("the answer is "), v)).otherwise(F.concat(F.lit("= "), v, F.lit(".5")))
    )
    num = text.training_answer(said, chat=True)
    return t("orders").select(F.col("o_orderkey").alias("id"), F.when(k == 5, F.floor(num["num"]).cast("double")).otherwise(num["num"]).alias("num"), num["str"].alias("str"), predictions.program_words(said).alias("words"), text.prompt_answer(said).alias("shown"))


@query("""
WITH b AS (SELECT item_id, item_id % 11 AS k, CASE item_id % 11 WHEN 0 THEN 'phi-4' WHEN 1 THEN 'qwen' WHEN 2 THEN 'llama-3.1' WHEN 3 THEN 'llama-2' WHEN 4 THEN 'gemma-3' WHEN 5 THEN 'gemma' WHEN 6 THEN 'phi-2' WHEN 7 THEN 'falcon' WHEN 8 THEN 'yi' WHEN 9 THEN 'claude' ELSE 'chatml' END AS template FROM benchmark),
n AS (SELECT *, chr(10) AS nl FROM b)
SELECT item_id, template, CASE WHEN template IN ('qwen', 'yi', 'chatml') THEN '<|im_start|>system' || nl || 's<|im_end|>' || nl || '<|im_start|>user' || nl || 'u<|im_end|>' || nl || '<|im_start|>assistant' || nl || 'a<|im_end|>' || nl
  WHEN template = 'phi-4' THEN '<|im_start|>system<|im_sep|>s<|im_end|><|im_start|>user<|im_sep|>u<|im_end|><|im_start|>assistant<|im_sep|>a<|im_end|>'
  WHEN template = 'llama-3.1' THEN '<|system|>' || nl || 's' || nl || '<|user|>' || nl || 'u' || nl || '<|assistant|>' || nl || 'a' || nl
  WHEN template = 'llama-2' THEN '<s><<SYS>>' || nl || 's' || nl || '<</SYS>>' || nl || nl || '[INST] u [/INST] a </s><s>'
  WHEN template IN ('gemma-3', 'gemma') THEN '<bos>s' || nl || '<start_of_turn>user' || nl || 'u<end_of_turn>' || nl || '<start_of_turn>model' || nl || 'a<end_of_turn>' || nl
  WHEN template = 'phi-2' THEN 's' || nl || 'Instruct: u' || nl || 'Output: a' || nl WHEN template = 'falcon' THEN 'System: s' || nl || 'User: u' || nl || 'Falcon: a' || nl
  ELSE 's' || nl || 'Human: u' || nl || 'Assistant: a' || nl END AS rendered FROM n""")
def chat_templates(t):
    """each template that a model's name can lead to."""
    names = ["microsoft/phi4-mini", "Qwen2-7B", "Llama3.1-8B", "Mistral-7B", "google/gemma3-4b", "gemma-7b", "phi-2", "falcon-7b", "Yi-6B", "claude-x", "other"]
    model = F.element_at(F.array(*map(F.lit, names)), (F.col("item_id") % len(names) + 1).cast("int"))
    name = text.template_name(model)
    messages = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(r[0]).alias("content")) for r in ("system", "user", "assistant")))
    said = F.lit(None).cast("string")
    for x in text.TEMPLATES:
        said = F.when(name == x, text.render(messages, x)).otherwise(said)
    return t("benchmark").select("item_id", name.alias("template"), said.alias("rendered"))


@query("""
SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS plain, CASE WHEN regexp_matches(lower(url), 'table|row|column|total|how much|how many|percent|[0-9]{4}') THEN 'table' ELSE 'text' END AS tool,
  strpos(html, '<body') > 0 AND strpos(html, '<article') > strpos(html, '<body') AND strpos(html, '</html>') > strpos(html, '<article') AS in_order FROM pages""")
def page_cleaning(t):
    """Pages without their tags, the route of their addresses, markers in order."""
    return t("pages").select("page_id", text.clean_html(F.col("html")).alias("plain"), text.route(F.col("url")).alias("tool"), training.markers_in_order(F.col("html"), "<body", "<article", "</html>").alias("in_order"))


@query("""
WITH m AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'about ' || turn || ' of it' WHEN 1 THEN 'nothing' ELSE '<begin_of_answer>' || turn || '<end_of_answer>' END AS said FROM conversations),
i AS (SELECT *, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN '<begin_of_program>' || chr(10) || 'EOF' || chr(10) || '<end_of_program>' || chr(10) || chr(10) || '<begin_of_answer>' || chr(10) || turn || chr(10) || '<end_of_answer>' ELSE said END AS content FROM m)
SELECT conv_id, list(content ORDER BY turn) AS contents, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN regexp_replace(arg_max(content, turn) FILTER (role = 'assistant'), '^\\s+|\\s+$', '', 'g') ELSE string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) END AS last_said FROM i GROUP BY conv_id""".replace("\\\\", "\\"))
def answer_tags(t):
    """numbers of untagged replies get tags; the last reply is read back from the rendered chat."""
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("about "), F.col("turn").cast("string"), F.lit(" of it"))).when(F.col("turn") % 3 == 1, "nothing").otherwise(F.concat(F.lit("<begin_of_answer>"), F.col("turn").cast("string"), F.lit("<end_of_answer>")))
    held = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("content")))).alias("ms"))
    tagged = held.select("conv_id", text.inject_answer_tags(F.col("ms")).alias("ms"))
    return tagged.select("conv_id", F.transform("ms", lambda m: m["content"]).alias("contents"), text.last_assistant_turn(text.render(F.col("ms"), "chatml")).alias("last_said"))


@query("""
SELECT 'doc_' || doc_id AS id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN ' ' || lang ELSE '' END || chr(10) || chr(10) || source || chr(10) || chr(10) || text, '^\\s+|\\s+$', '', 'g') AS content, 'made' AS source, lang AS filename FROM documents""".replace("\\\\", "\\"))
def knowledge_base(t):
    """Documents as knowledge items."""
    docs = t("documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("filename"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("lang"))).otherwise("").alias("pre"), F.col("source").alias("table"), F.col("text").alias("post"))
    return writers.knowledge_rows(docs, "made").select("id", "content", "metadata.source", "metadata.filename")


@query("""
WITH c AS (SELECT conv_id AS id, list(text ORDER BY turn) FILTER (role = 'user') AS q, list(length(text) ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1),
x AS (SELECT id, q, a, unnest(range(0, least(coalesce(len(q), 0), coalesce(len(a), 0)))) AS turn FROM c)
SELECT id, turn::INT AS turn, q[turn + 1] AS question, a[turn + 1]::VARCHAR AS gold, 'train' AS split FROM x WHERE id % 2 = 0
UNION ALL SELECT id, turn::INT, q[turn + 1], a[turn + 1]::VARCHAR, 'test' FROM x WHERE id % 2 = 1""")
def zipped_turns(t):
    """Questions and answers as parallel arrays, zipped to turns up to the shorter one, in two splits."""
    of = lambda role, c: F.transform(F.filter("ms", lambda m: m["role"] == role), lambda m: m[c])
    held = t("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.length("text").alias("n")))).alias("ms"))
    turns = dialogue.turns_of(held.select("id", of("user", "text").alias("q"), of("assistant", "n").alias("a")), "q", "a")
    return training.with_splits(train=turns.where("id % 2 = 0"), test=turns.where("id % 2 = 1"))


@query("""
SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN rpad('k', greatest(1, length(n_name))::INT, ' ') || chr(10) || repeat('-', greatest(1, length(n_name))::INT) || chr(10) || rpad(n_name, greatest(1, length(n_name))::INT, ' ')
  WHEN 1 THEN 'No table data found.' WHEN 2 THEN n_name || chr(10) || repeat('-', length(n_name)::INT) ELSE '' END AS shown FROM nation""")
def table_cascade(t):
    """The annotation's table, its sentinel, a direct table, or none."""
    k, cells = F.col("n_nationkey") % 4, F.array(F.array("n_name"))
    none = F.array().cast("array<array<string>>")
    html = F.when(k == 0, F.concat(F.lit("<table><tr><td>k</td></tr><tr><td>"), F.col("n_name"), F.lit("</td></tr></table>"))).otherwise("")
    shown = tables.table_text(k < 2, html, none, F.when(k == 2, cells).otherwise(none))
    return _shipped(t("nation")).select(F.col("n_nationkey").alias("id"), shown.alias("shown"))


# --- extension -------------------------------------------------------------------------------------------------------


@query("""
SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(t):
    """Extension, not of the reference: daily windows as ``streaming.ingest`` has them."""
    return t("events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


