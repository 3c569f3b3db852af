"""One registered query per operator, over whole tables with production settings, and SQL twins where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    chat_format,
    decontaminate,
    language_id,
    line_dedup,
    order_minhash,
    packing,
    prefix_trie,
    quality,
    spelling,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
)
from corpusloom.llm.common import held_out

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
s AS (SELECT doc_id, i - 1 AS pos, trim(a[i]) AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
n AS (SELECT doc_id, pos, line, lead(pos, 2) OVER w AS last, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3
    FROM s WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS nth,
    first(doc_id) OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS d0,
    first(last) OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS e0 FROM n WHERE l3 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN d0 = doc_id THEN greatest(pos, e0 + 1) ELSE pos END, last + 1)) AS pos
    FROM w WHERE nth > 1),
p AS (SELECT l.doc_id, a[i] AS line, i, c.pos IS NOT NULL AS gone
    FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l) l LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = i - 1)
"""
KEPT_LINES = """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM p GROUP BY doc_id"""


@query(LINES + KEPT_LINES)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows."""
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


MARKS = sum(len(mark) for mark in chat_format.PRINTED.values())
ESCAPED = "regexp_replace({}, '(<)(\\\\*)(\\|turn\\|>|\\|text\\|>|\\|end\\|>|\\|endoftext\\|>|\\|im_start\\|>|\\|im_end\\|>|s>|/s>)|(\\[)(\\\\*)(/?INST\\])', '\\1\\4\\\\\\2\\5\\3\\6', 'g')"


@query(rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, {MARKS} + len({ESCAPED.format("role")}) + len({ESCAPED.format("text")}) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    formatted = chat_format.format_turns(rows.unionByName(planted))
    return chat_format.conversation_digests(chat_format.read_back(formatted))


@query()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    done = order_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "class_id", "keeper")


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    done = toxicity.score(docs, model, doc_id=F.col("doc_id"))
    return done.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS width, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i:
    array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS spot FROM b WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM iw),
dw AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS spot
    FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)),
m AS (SELECT doc_id, item_id, i, dw.width FROM dw JOIN iw USING (width, spot)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and the items hit."""
    done = decontaminate.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and compression verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), doc_id=F.col("doc_id"))


TOKEN_LIMIT = 512


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    done = token_counts.token_counts(table(spark, sf_dir, "documents"), doc_id=F.col("doc_id"))
    return done.withColumn("over_limit", token_counts.over_limit(TOKEN_LIMIT))


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 2048 tokens."""
    return packing.digest_columns(packing.pack(table(spark, sf_dir, "documents"), doc_id=F.col("doc_id")))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    done = language_id.identify(docs, model, doc_id=F.col("doc_id"))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# crc32 of a list of character codes, bit by bit.
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, x: list_reduce(
    list_prepend(xor(c, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE z END))),
    4294967295)"""


def misspelt(doc_id: str, word: str) -> str:
    """A spelling error in one of 199 words of a document, the same wherever it occurs there."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


LETTERS = "[A-Za-z\\x{00C0}-\\x{00FF}]+"
RUN_CODES = """list_transform(range(1, octet_length(b) + 1), lambda i: CAST(('0x' || hex(b)[2 * i - 1:2 * i]) AS BIGINT))"""


@query(rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LETTERS}')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS n FROM r GROUP BY id, run),
h AS (SELECT run, n, {CRC.format(codes=RUN_CODES)} AS h FROM (SELECT run, n, encode(id || ':' || run) AS b FROM g)),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 <> 0 THEN run
    ELSE substr(run, 1, CAST(h % len(run) AS BIGINT)) || substr(run, CAST(h % len(run) AS BIGINT) + 2) END AS word, n FROM h)
    WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM w)),
l AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT word, rest FROM d WHERE rest IN (SELECT word FROM w) UNION SELECT rest, word FROM d WHERE rest IN (SELECT word FROM w)),
m AS (SELECT l.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS form, max(w.n) AS form_n FROM l JOIN w ON w.word = l.near GROUP BY l.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
    CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM w LEFT JOIN m USING (word)),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them misspelt, with their more frequent neighbours."""
    return spelling.group_variants(table(spark, sf_dir, "documents"), change=misspelt)


@query()
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that start twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digest_columns(suffix_dedup.remove_repeats(docs))


SHARED_TURNS = 9
CONV_CODES = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"


def borrowed(conv_id: int) -> int:
    """How many first turns a conversation takes from its block's first one."""
    return zlib.crc32(b"%d" % conv_id) % SHARED_TURNS


@query(f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, {CRC.format(codes=CONV_CODES)} % {SHARED_TURNS} AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - (c.conv_id % 5 + 5) % 5 AND pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
w AS (SELECT conv_id, own, pos, strlen(text) AS size, md5(len(role) || ':' || role || text) AS id FROM r),
s AS (SELECT conv_id, list(id ORDER BY own, pos) AS ids, list(size ORDER BY own, pos) AS sizes FROM w GROUP BY conv_id
    UNION ALL SELECT conv_id, [], [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM w)),
p AS (SELECT conv_id, d, len(ids) = d AS ends, array_to_string(ids[1:d], ',') AS path, array_to_string(ids[1:d - 1], ',') AS up,
    CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM s)),
n AS (SELECT path, any_value(CASE WHEN d > 0 THEN up END) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ended FROM p GROUP BY path, d),
k AS (SELECT up, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY up, d),
e AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.path AND k.d = n.d),
a AS (SELECT path, d, a_d, array_to_string(string_split(path, ',')[1:a_d], ',') AS a_path, n_children, (n_convs - 1) * size AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS a_d FROM e)),
b AS (SELECT a_path, a_d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM a GROUP BY a_path, a_d)
SELECT e.conv_id, e.d AS depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, b.n_leaves,
    CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ended, '')) AS ends_sha256
FROM e JOIN b ON b.a_path = e.path AND b.a_d = e.d LEFT JOIN e u ON u.path = e.up AND u.d = e.d - 1""")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, which share first turns by blocks of five."""
    turns = prefix_trie.turn_digests(table(spark, sf_dir, "conversations"))
    block = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    return prefix_trie.trie(prefix_trie.paths(turns, block, borrowed))
