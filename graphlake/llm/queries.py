"""The registered queries of the thirteen operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import common, decontamination, language_id, lm_scoring, merge_replay, merkle, near_dedup, packing, prefix_trie, sharding, subwords, token_counts, token_files, topk_search, toxicity


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    return decontamination.decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), 10)


def op2_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of them."""
    docs = common.read(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 4, 2))
    prototypes = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.identify(docs, prototypes, keep=["held_out"])


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector's five best by integer inner product."""
    vectors = topk_search.scaled(common.read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected severity of every document."""
    docs = common.read(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = common.read(spark, sf_dir, "documents")
    return token_counts.with_limit(token_counts.token_counts(docs, subwords.tokenizer_path("word_bpe_49k.json")), 2048)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' places in the token files, read back from them."""
    docs = common.read(spark, sf_dir, "documents")
    files = token_files.write_token_files(docs, subwords.tokenizer_path("byte_bpe_50k.json"), 0)
    return token_files.read_token_files(files)


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = near_dedup.near_duplicates(common.read(spark, sf_dir, "documents"), 3, 3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_lpt_shards(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """Documents in 16 shards of near equal bytes; equal texts share one."""
    text = F.col("text")
    rows = common.read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("group_key"),
    )
    placed = sharding.lpt_shards(rows, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document by the attention model and by a unigram base."""
    docs = common.read(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 5, 1))
    return lm_scoring.score_documents(docs, subwords.tokenizer_path("word_bpe_49k.json"))


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed with their lexical neighbours."""
    return packing.pack_documents(common.read(spark, sf_dir, "documents"), subwords.tokenizer_path("word_bpe_49k.json"), 2048, 1)


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document (null text: none) by a replay of all merges over the corpus' chunks, and what they decode to."""
    words = merge_replay.vocabulary("byte_bpe_50k.tiktoken")
    found = merge_replay.decode(merge_replay.encode(common.read(spark, sf_dir, "documents"), words), words)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixes of all conversations, each of which begins as the conversation whose number is its own less its rest by 5."""
    number = F.col("conv_id")
    shared = F.crc32(number.cast("string").cast("binary")) % 9
    return prefix_trie.trie(prefix_trie.rebuilt(common.read(spark, sf_dir, "conversations"), number - number % 5, shared, 8))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and the root that it folds to; half of the documents are checked without line feeds."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(common.read(spark, sf_dir, "documents"), tampered).drop("proof")


QUERIES = {
    "op1_positional_index": op1_positional_index,
    "op2_hyperdimensional_langid": op2_hyperdimensional_langid,
    "op3_maxscore_topk": op3_maxscore_topk,
    "op4_ordinal_toxicity": op4_ordinal_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_simhash_vptree": op7_simhash_vptree,
    "op8_lpt_shards": op8_lpt_shards,
    "op9_attention_lm": op9_attention_lm,
    "op10_bm25_packing": op10_bm25_packing,
    "op11_merge_replay": op11_merge_replay,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

WORDS_SQL = r"""list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

#: The unsigned CRC-32 of a decimal number: eight steps for each of its characters.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _merkle_sql(levels: int) -> str:
    """Leaves and trees of at most 3 ** levels nodes; each level has its nodes with their siblings left and right."""
    fields = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in merkle.FIELDS]
    changed = fields[-1].replace("text", r"replace(text, chr(10), '')")
    steps = [
        f"""leaf AS (SELECT doc_id, source AS s, sha256({' || '.join(fields)}) AS h,
            CASE WHEN {CRC_SQL.format("doc_id")} % 2 = 0 THEN sha256({' || '.join([*fields[:-1], changed])}) ELSE sha256({' || '.join(fields)}) END AS cur FROM documents)""",
        """l0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY s) AS n, h, doc_id, cur FROM leaf)""",
    ]

    def tree(name: str, first: str) -> None:
        for k in range(levels):
            run = "PARTITION BY s, i // 3 ORDER BY i"
            steps.append(f"""{name}s{k} AS (SELECT s, i, n, h, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS a,
                CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS b FROM {first if k == 0 else f"{name}{k}"})""")
            steps.append(f"""{name}{k + 1} AS (SELECT s, i // 3 AS i, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}s{k} GROUP BY s, i // 3, n)""")

    tree("l", "l0")
    steps.append(f"t0 AS (SELECT 0 AS s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, s AS source FROM l{levels})")
    tree("t", "t0")
    steps.append("f0 AS (SELECT doc_id, s, i, n, h AS leaf, cur, '' AS p FROM l0)")

    def fold(name: str, at: int) -> None:
        for k in range(levels):
            key = "z.s IS NOT DISTINCT FROM f.s" if name == "l" else "true"
            steps.append(f"""f{at + k + 1} AS (SELECT doc_id, f.s, f.i // 3 AS i, (f.n + 2) // 3 AS n, leaf, CASE WHEN f.n > 1 THEN sha256(a || cur || b) ELSE cur END AS cur, p || a || b AS p
                FROM f{at + k} f JOIN {name}s{k} z ON {key} AND z.i = f.i)""")

    fold("l", 0)
    steps.append(f"f{levels + 1} AS (SELECT doc_id, f.s, t.i, t.n, leaf, cur, p FROM f{levels} f JOIN t0 t ON t.source IS NOT DISTINCT FROM f.s)")
    fold("t", levels + 1)
    return f"""WITH {', '.join(steps)} SELECT doc_id, leaf, x.h AS subroot, r.h AS root, sha256(p) AS proof_sha256, cur AS folded_root, cur = r.h AS verified
        FROM f{2 * levels + 1} f JOIN l{levels} x ON x.s IS NOT DISTINCT FROM f.s, t{levels} r"""


ORACLE_SQL = {
    "op1_positional_index": f"""
        WITH d AS (SELECT doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
        b AS (SELECT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark),
        g AS (SELECT item_id, w[i : i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
        n AS (SELECT DISTINCT len(win) AS n FROM g),
        p AS (SELECT doc_id, w, n.n, unnest(range(1, len(w) - n.n + 2)) AS i FROM d, n WHERE len(w) >= n.n),
        m AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i : i + n - 1] AS win FROM p) JOIN g USING (win)),
        h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op3_maxscore_topk": """
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS tid,
                   octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list({{'tid': tid, 'size': size}} ORDER BY turn NULLS FIRST, tid) AS own FROM t GROUP BY conv_id),
        h AS (SELECT *, {CRC_SQL.format("conv_id")} % 9 AS h FROM o),
        r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS w FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
        p AS (SELECT conv_id, d, len(w) AS n, array_to_string(list_transform(w[1:d], lambda x: x.tid), '') AS k, coalesce(w[d].size, 0) AS size
              FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM r)),
        g AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '') AS e
              FROM p GROUP BY k, d),
        c AS (SELECT k[1:32 * (d - 1)] AS k, d - 1 AS d, count(*) AS kids FROM g WHERE d > 0 GROUP BY ALL),
        m AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN c USING (k, d)),
        u AS (SELECT k[1:32 * a] AS k, a AS d, sum(CAST(kids = 0 AS BIGINT)) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL)
        SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, CAST(m.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(m.e) AS ends_sha256
        FROM m JOIN u ON u.k = m.k AND u.d = m.d LEFT JOIN m q ON q.k = m.k[1:32 * (m.d - 1)] AND q.d = m.d - 1
    """,
    "op13_merkle_manifest": _merkle_sql(10),
}
