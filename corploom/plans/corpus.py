"""Queries of the corpus pipeline: sources, text functions, vocabulary, batches, combinators, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corploom.functions import arrays
from corploom.functions import text as tx
from corploom.functions import tokenizers as tk
from corploom.operators import batching, combinators, metrics, positions, vocab, windows
from corploom.operators.tables import written
from corploom.plans import base
from corploom.plans.base import table
from corploom.sources import records, sinks
from corploom.sources import text as source

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"
_WS = r"list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')"


@query(f"WITH {base.SQL_STREAM} SELECT token, count(*) AS cnt, min(gpos) AS first_pos FROM stream GROUP BY token")
def token_counts(spark, d):
    return vocab.token_counts(base.token_stream(spark, d))


@query(f"WITH {base.SQL_STREAM}, {base.SQL_VOCAB.replace('{size}', '5000')} SELECT token, token_id, cnt FROM vocab")
def vocab_topk(spark, d):
    return base.documents_vocab(spark, d)


@query(f"WITH {base.sql_ids()} SELECT gpos, token_id FROM ids")
def encode_unk(spark, d):
    return base.encoded_stream(spark, d)


@query(f"WITH {base.sql_ids()}, v AS (SELECT token_id, token FROM vocab) SELECT gpos, token FROM ids JOIN v USING (token_id)")
def decode_ids(spark, d):
    return vocab.decode(base.encoded_stream(spark, d), base.documents_vocab(spark, d), 5002).select("gpos", "token")


@query(f"""WITH {base.sql_ids()}, n AS (SELECT count(*) // 16 AS n_step FROM ids),
placed AS (SELECT gpos % n_step AS t, gpos // n_step AS b, token_id, n_step FROM ids, n WHERE gpos < n_step * 16),
x AS (SELECT t // 32 AS batch_id, b, list(token_id ORDER BY t) AS input FROM placed WHERE t < n_step - 1 GROUP BY 1, 2),
y AS (SELECT (t - 1) // 32 AS batch_id, b, list(token_id ORDER BY t) AS target FROM placed WHERE t > 0 GROUP BY 1, 2)
SELECT CAST(batch_id AS INTEGER) AS batch_id, CAST(b AS INTEGER) AS b, array_to_string(input, ' ') AS input, array_to_string(target, ' ') AS target FROM x JOIN y USING (batch_id, b)""")
def lm_ordered_batches(spark, d):
    out = windows.ordered(base.encoded_documents(spark, d), "ids", base.n_tokens(spark, d), 16, 32)
    return out.select("batch_id", "b", F.array_join("input", " ").alias("input"), F.array_join("target", " ").alias("target"))


@query(f"""WITH {base.sql_ids()}, n AS (SELECT count(*) // 8 AS n_step FROM ids),
placed AS (SELECT gpos // n_step AS r, gpos % n_step AS c, token_id, n_step FROM ids, n WHERE gpos < n_step * 8),
nx AS (SELECT *, lead(token_id) OVER (PARTITION BY r ORDER BY c) AS nxt FROM placed)
SELECT CAST(c // 64 AS INTEGER) AS batch_id, CAST(r AS INTEGER) AS row, array_to_string(list(token_id ORDER BY c), ' ') AS inputs, array_to_string(list(nxt ORDER BY c), ' ') AS target
FROM nx WHERE c < ((n_step - 1) // 64) * 64 GROUP BY 1, 2""")
def batchify_windows(spark, d):
    out = windows.ordered(base.encoded_documents(spark, d), "ids", base.n_tokens(spark, d), 8, 64, whole=True)
    return out.select("batch_id", F.col("b").alias("row"), F.array_join("input", " ").alias("inputs"), F.array_join("target", " ").alias("target"))


@query(f"""WITH {base.sql_ids()}, n AS (SELECT count(*) // 8 AS n_step, count(*) % 8 AS rest FROM ids),
placed AS (SELECT (gpos - greatest(rest - 1, 0)) // n_step AS r, (gpos - greatest(rest - 1, 0)) % n_step AS c, token_id, n_step FROM ids, n WHERE gpos >= greatest(rest - 1, 0) AND gpos - greatest(rest - 1, 0) < n_step * 8),
nx AS (SELECT *, lead(token_id) OVER (PARTITION BY r ORDER BY c) AS nxt FROM placed)
SELECT CAST(c // 64 AS INTEGER) AS batch_id, CAST(r AS INTEGER) AS row, array_to_string(list(token_id ORDER BY c), ' ') AS inputs, array_to_string(list(nxt ORDER BY c), ' ') AS target
FROM nx WHERE c < ((n_step - 1) // 64) * 64 GROUP BY 1, 2""")
def batchify_second_pass(spark, d):
    n = base.n_tokens(spark, d)
    rows = batching.batchify(base.encoded_stream(spark, d), n, 8, batching.pass_start(n, 8, 1))
    return batching.fixed_windows(rows, n // 8, 64).select("batch_id", "row", F.array_join("inputs", " ").alias("inputs"), F.array_join("target", " ").alias("target"))


@query(f"""WITH {base.sql_ids()} SELECT CAST(gpos // 127 AS BIGINT) AS seq_no, array_to_string(list_append(list(token_id ORDER BY gpos), 1), ' ') AS token_ids FROM ids GROUP BY 1 HAVING count(*) = 127""")
def chunk_sequences(spark, d):
    return windows.chunks(base.encoded_documents(spark, d), "ids", 128, eos=1).select("seq_no", F.array_join("ids", " ").alias("token_ids"))


@query(f"""WITH {base.sql_ids()}, nx AS (SELECT gpos, token_id, lead(token_id) OVER (ORDER BY gpos) AS nxt FROM ids)
SELECT CAST(gpos // 128 AS BIGINT) AS seq_no, array_to_string(list(token_id ORDER BY gpos), ' ') AS inputs, array_to_string(list(nxt ORDER BY gpos), ' ') AS target FROM nx WHERE nxt IS NOT NULL GROUP BY 1 HAVING count(*) = 128""")
def lm_overlap_windows(spark, d):
    return windows.overlapping(base.encoded_documents(spark, d), "ids", 128).select("seq_no", F.array_join("inputs", " ").alias("inputs"), F.array_join("target", " ").alias("target"))


@query(f"""WITH {base.SQL_HASHED}, lane AS (SELECT *, doc_id % 8 AS shard, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id, p) - 1 AS g FROM h),
ch AS (SELECT shard, g // 128 AS seq_no, list(token_id ORDER BY g) AS ids FROM lane GROUP BY 1, 2 HAVING count(*) = 128),
ok AS (SELECT seq_no FROM ch GROUP BY 1 HAVING count(DISTINCT shard) = 8)
SELECT CAST(seq_no AS BIGINT) AS batch_id, CAST(shard AS INTEGER) AS row_id, array_to_string(ids, ' ') AS token_ids FROM ch JOIN ok USING (seq_no)""")
def shard_zip_batches(spark, d):
    docs = base.hashed_documents(spark, d).withColumn("shard", (F.col("doc_id") % 8).cast("int"))
    chunks = written(windows.chunks(windows.with_offsets(docs, "doc_id", "ids", ("shard",)), "ids", 128, by=("shard",)))
    return batching.shard_zip(chunks, 8).select("batch_id", "row_id", F.array_join("ids", " ").alias("token_ids"))


@query(f"""WITH {_LINES} SELECT doc_id, line_no, array_to_string(list_concat(list_concat(['<S>'], {_WS}), ['<S>']), ' ') AS framed, len({_WS}) AS n FROM lines WHERE len({_WS}) > 0""")
def sent_eos_framing(spark, d):
    rows = source.document_lines(table(spark, d, "documents"))
    words = tx.words(F.col("line"))
    return rows.where(F.size(words) > 0).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join(tx.tokenize_line(F.col("line"), add_double_eos=True), " ").alias("framed"), F.size(words).cast("long").alias("n"))


@query(f"""WITH {_LINES}, spaced AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 3 THEN '' ELSE line END AS line FROM lines),
m AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS doc_no FROM spaced)
SELECT doc_id, CAST(doc_no AS BIGINT) AS doc_no, CAST(count(*) AS BIGINT) AS n_sents, CAST(sum(len({_WS})) AS BIGINT) AS n_tokens FROM m WHERE trim(line) <> '' GROUP BY 1, 2 HAVING sum(len({_WS})) >= 20""")
def doc_assembly(spark, d):
    rows = source.document_lines(table(spark, d, "documents")).withColumn("line", F.when(F.col("line_no") % 4 == 3, "").otherwise(F.col("line")))
    return source.documents(rows, ("doc_id",), 20).select("doc_id", F.col("doc_no").cast("long").alias("doc_no"), F.size("sents").cast("long").alias("n_sents"), "n_tokens")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, line_no, {_WS} AS ws FROM lines),
k AS (SELECT doc_id, unnest(ws) AS w, line_no, unnest(range(len(ws))) AS p FROM s WHERE len(ws) > 0)
SELECT doc_id, array_to_string(list(CAST(('0x' || substr(md5(w), 1, 7))::BIGINT % 1000 + 10 AS INTEGER) ORDER BY line_no, p), ' ') AS inputs, array_to_string(list(p ORDER BY line_no, p), ' ') AS pos_seq, CAST(0 AS BIGINT) AS type_id FROM k GROUP BY doc_id""")
def doc_pos_seq(spark, d):
    sents = F.filter(F.transform(F.split("text", "\n"), tx.words), lambda w: F.size(w) > 0)
    docs = table(spark, d, "documents").select("doc_id", F.transform(sents, lambda w: base.hashed_ids(w)).alias("sents")).where(F.size("sents") > 0)
    return sinks.document_records(docs).select("doc_id", F.array_join("inputs", " ").alias("inputs"), F.array_join("pos_seq", " ").alias("pos_seq"), F.col("type_id")[0].cast("long").alias("type_id"))


@query("SELECT 'out/' || source || '.rec' AS filename, count(*) AS num_example FROM documents GROUP BY 1")
def manifest_counts(spark, d):
    rows = table(spark, d, "documents").withColumn("path", F.concat(F.lit("/data/"), F.col("source"), F.lit(".rec")))
    made = sinks.manifest(rows).select(F.lit("out").alias("dir"), F.lit(0).alias("pass_id"), F.array("filename").alias("filenames"), "num_example")
    return records.merged_manifests(made, "num_example", 1).select("filename", F.col("n_total").alias("num_example"))


@query("""WITH f AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), m AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS i, count(*) OVER (PARTITION BY source) AS k, sum(n) OVER (PARTITION BY source) AS n,
CAST(('0x' || substr(md5(source), 1, 4))::BIGINT % 3 AS INTEGER) AS pass_id FROM f), s AS (SELECT *, least(2, k) AS eff, CAST(floor(CAST(n AS DOUBLE) * (CAST(least(2, k) AS DOUBLE) / CAST(k AS DOUBLE))) AS BIGINT) AS t FROM m WHERE pass_id < 2)
SELECT source || '/' || lang AS filename, CAST(t // eff + CASE WHEN i < t % eff THEN 1 ELSE 0 END AS BIGINT) AS n, t AS n_total FROM s WHERE i < eff""")
def manifest_passes(spark, d):
    """Each source's files (one a language) as a manifest of one of three passes, of which two are read."""
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    made = counts.groupBy("source").agg(F.array_sort(F.collect_list(F.concat(F.lit("old/"), "lang"))).alias("filenames"), F.sum("n").alias("num_batch"))
    made = made.withColumn("pass_id", (F.conv(F.substring(F.md5("source"), 1, 4), 16, 10).cast("long") % 3).cast("int")).withColumnRenamed("source", "dir")
    return records.merged_manifests(made, "num_batch", 2)


@query("SELECT doc_id, CAST((dense_rank() OVER (ORDER BY source) - 1) % 4 AS INTEGER) AS task FROM documents")
def interleaved_tasks(spark, d):
    from pyspark.sql import Window

    files = table(spark, d, "documents").select("source").distinct().withColumn("file_idx", F.dense_rank().over(Window.orderBy("source")))
    docs = table(spark, d, "documents").join(F.broadcast(files), "source")  # as many rows as files
    return base.union([combinators.interleaved_task(docs, "file_idx", 4, k).select("doc_id", F.lit(k).alias("task")) for k in range(4)])


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, line_no, replace(line, ' of ', chr(9)) AS line FROM lines)
SELECT doc_id, line_no, string_split(line, chr(9))[1] AS source, string_split(line, chr(9))[2] AS target FROM t WHERE len(string_split(line, chr(9))) = 2""")
def tsv_pairs(spark, d):
    rows = source.document_lines(table(spark, d, "documents")).withColumn("line", F.replace("line", F.lit(" of "), F.lit("\t")))
    return source.pairs(rows).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "source", "target")


@query(r"""SELECT doc_id, length(r) AS n, md5(r) AS digest FROM (
SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[\t\n\r ]', ' ', 'g'), '([!-/:-@\[-`{-~]|\p{P})', ' \1 ', 'g') AS r FROM documents)""")
def basic_normalize(spark, d):
    out = tx.split_punctuation(tx.space_cjk(tx.clean(F.lower("text"))))
    return table(spark, d, "documents").select("doc_id", F.length(out).cast("long").alias("n"), F.md5(out).alias("digest"))


@query("SELECT doc_id, CAST(length(replace(text, chr(10), '')) AS BIGINT) AS n_chars, md5(array_to_string(string_split(replace(replace(trim(text, ' ' || chr(10)), ' ', '_'), chr(10), ''), ''), ' ')) AS digest FROM documents")
def char_tokens(spark, d):
    flat = F.replace("text", F.lit("\n"), F.lit(""))
    spaced = F.array_join(F.filter(F.split(F.replace(F.translate(tx.strip(F.col("text")), " ", "_"), F.lit("\n"), F.lit("")), ""), lambda c: c != ""), " ")
    return table(spark, d, "documents").select("doc_id", F.length(flat).cast("long").alias("n_chars"), F.md5(spaced).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS is_start FROM documents")
def piece_classes(spark, d):
    piece = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("▁"), F.col("source"))).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(F.lit("<unk>"))
    return table(spark, d, "documents").select("doc_id", tx.is_start_piece(piece).cast("int").alias("is_start"))


@query(f"""WITH {_LINES}, f AS (SELECT doc_id, line_no, {_WS}[1] AS token FROM lines), k AS (SELECT token, min(doc_id * 100000 + line_no) AS line_no FROM f WHERE token IS NOT NULL GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY line_no) - 1 AS INTEGER) AS token_id FROM k""")
def vocab_file(spark, d):
    rows = source.document_lines(table(spark, d, "documents")).select((F.col("doc_id") * 100000 + F.col("line_no")).alias("line_no"), "line")
    return vocab.vocab_from_lines(rows)


@query(f"""WITH {base.sql_ids()} SELECT gpos, CAST(CASE WHEN token_id < 100 THEN 0 WHEN token_id < 1000 THEN 1 ELSE 2 END AS INTEGER) AS cluster,
CAST(token_id - CASE WHEN token_id < 100 THEN 0 WHEN token_id < 1000 THEN 100 ELSE 1000 END AS INTEGER) AS local_id FROM ids""")
def adaptive_buckets(spark, d):
    cluster, local = vocab.adaptive_cluster(F.col("token_id"), [100, 1000], 10_000)
    return base.encoded_stream(spark, d).select("gpos", cluster.alias("cluster"), local.alias("local_id"))


@query(f"""WITH {base.sql_ids()}, b AS (SELECT token_id, coalesce(sum(cnt) OVER (ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(cnt) OVER () AS n FROM vocab),
k AS (SELECT CASE WHEN bef * 20 < n * 10 THEN 0 WHEN bef * 20 < n * 15 THEN 1 WHEN bef * 20 < n * 18 THEN 2 ELSE 3 END AS cluster, min(token_id) AS first_id, max(token_id) AS last_id FROM b GROUP BY 1)
SELECT gpos, token_id, CAST(cluster AS INTEGER) AS cluster, CAST(token_id - first_id AS INTEGER) AS local_id FROM ids LEFT JOIN k ON token_id BETWEEN first_id AND last_id""")
def coverage_clusters(spark, d):
    """Clusters whose cutoffs lie where half, three quarters and nine tenths of the vocabulary's occurrences are reached."""
    vocabulary = written(base.documents_vocab(spark, d))
    ids = vocab.encode(base.token_stream(spark, d), vocabulary, 0, 5000 + len(base.SPECIALS)).select("gpos", "token_id")
    return vocab.cluster_join(ids, written(vocab.coverage_cutoffs(vocabulary, [10, 15, 18], 20))).select("gpos", "token_id", "cluster", "local_id")


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, {_WS} AS ws FROM lines) SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_docs, CAST(sum(CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_lines, CAST(sum(len(ws)) AS BIGINT) AS n_tokens FROM w""")
def corpus_counters(spark, d):
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.size(tx.words(x)) > 0))
    return metrics.corpus_counters(table(spark, d, "documents"), lines, F.size(tx.words(F.col("text"))))


_U = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(f"SELECT doc_id, {_U.format(chr(39) + '5|shuffle|0|' + chr(39) + ' || doc_id')} AS shuffle_key FROM documents")
def keyed_shuffle(spark, d):
    return combinators.shuffle_key(table(spark, d, "documents").select("doc_id"), ["doc_id"], 5)


@query(f"""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
a AS (SELECT doc_id, place, place // 32 * 32 + row_number() OVER (PARTITION BY place // 32 ORDER BY {_U.format(chr(39) + '5|buffer1|0|' + chr(39) + ' || doc_id')}, place) - 1 AS once FROM i)
SELECT doc_id, place, CAST(greatest((once + 16) // 32 * 32 - 16, 0) + row_number() OVER (PARTITION BY (once + 16) // 32 ORDER BY {_U.format(chr(39) + '5|buffer2|0|' + chr(39) + ' || doc_id')}, once) - 1 AS BIGINT) AS slot FROM a""")
def buffered_shuffle(spark, d):
    docs = positions.indexed(table(spark, d, "documents").select("doc_id"), "doc_id", "place")
    return combinators.buffered_shuffle(docs, "place", 64, ["doc_id"], 5).select("doc_id", "place", "slot")


@query("SELECT doc_id, CAST(e AS INTEGER) AS epoch FROM documents, range(3) r(e)")
def repeat_epochs(spark, d):
    return combinators.repeat(table(spark, d, "documents").select("doc_id"), 3)


@query(f"""WITH slots AS (SELECT i AS slot, CASE WHEN {_U.format("'3|mix|' || i")} / 4294967296.0 < 0.5 THEN 0 ELSE 1 END AS stream FROM range((SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings)) r(i)),
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY slot) - 1 AS idx FROM slots),
a AS (SELECT doc_id AS item, doc_id AS idx, 0 AS stream FROM documents UNION ALL SELECT vec_id + 1000000, vec_id, 1 FROM embeddings)
SELECT slot, CAST(n.stream AS INTEGER) AS stream, item FROM n JOIN a ON n.stream = a.stream AND n.idx = a.idx""")
def sample_from_datasets(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.col("doc_id").alias("idx"))
    vecs = table(spark, d, "embeddings").select((F.col("vec_id") + 1000000).alias("item"), F.col("vec_id").alias("idx"))
    return combinators.sample_from([docs, vecs], "idx", docs.count() + vecs.count(), 3).select("slot", "stream", "item")


@query("SELECT CAST(vec_id // 64 AS BIGINT) AS batch_id, CAST(vec_id % 64 AS INTEGER) AS row_id, label FROM embeddings WHERE vec_id < (SELECT count(*) // 64 * 64 FROM embeddings)")
def full_batches(spark, d):
    return batching.full_batches(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 64).select("batch_id", "row_id", "label")


@query("SELECT vec_id, label, (SELECT array_to_string(list(label ORDER BY vec_id), ' ') FROM embeddings p WHERE p.vec_id % 10 = e.vec_id % 10 AND p.vec_id < e.vec_id AND p.vec_id >= e.vec_id - 40) AS memory FROM embeddings e")
def memory_window(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 10).alias("stream"))
    out = batching.memory(rows, "stream", "vec_id", "label", 4)
    return out.select("vec_id", "label", F.when(F.size("memory") > 0, F.array_join("memory", " ")).alias("memory"))


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 32 < 4 THEN 0 WHEN vec_id % 32 - 4 < 10 THEN 1 + (vec_id % 32 - 4) // 10 ELSE 2 + (vec_id % 32 - 14) // 9 END AS INTEGER) AS device FROM embeddings")
def device_split(spark, d):
    return table(spark, d, "embeddings").select("vec_id", batching.device_of(F.col("vec_id") % 32, 32, 4, 4).alias("device"))


@query("SELECT CAST(ntile(10) OVER (ORDER BY vec_id) AS INTEGER) AS part, vec_id, label FROM embeddings")
def hidden_dump(spark, d):
    return sinks.dump_parts(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents), r AS (SELECT doc_id, ws, unnest(range(greatest((len(ws) + 49) // 50, 1))) AS k FROM w)
SELECT doc_id, CAST(k AS INTEGER) AS row_id, array_to_string(list_concat(ws[k * 50 + 1:k * 50 + 50], list_transform(range(greatest(k * 50 + 50 - len(ws), 0)), lambda i: '<pad>')), ' ') AS padded FROM r""")
def padded_batch(spark, d):
    """Whole texts in rows of 50 words, the last one padded."""
    docs = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("ws"))
    starts = F.transform(arrays.indices(F.greatest(F.ceil(F.size("ws") / 50), F.lit(1)).cast("int")), lambda k: F.slice("ws", k * 50 + 1, F.lit(50)))
    return docs.select("doc_id", F.posexplode(starts).alias("row_id", "row")).select("doc_id", "row_id", F.array_join(arrays.pad(F.col("row"), 50, "<pad>"), " ").alias("padded"))


@query()
def wordpiece_tokens(spark, d):
    vocabulary = ["<unk>", *[chr(c) for c in range(97, 123)], *["##" + chr(c) for c in range(97, 123)], "the", "##the", "##er", "##on", "an", "##an"]
    return table(spark, d, "documents").select("doc_id", F.size(tk.full_tokenizer(F.col("text"), vocabulary)).alias("n_pieces"))


@query("SELECT doc_id, CAST(length(strip_accents(text)) AS BIGINT) AS n, md5(strip_accents(text)) AS digest FROM documents")
def accents_stripped(spark, d):
    plain = tk.strip_accents(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(plain).cast("long").alias("n"), F.md5(plain).alias("digest"))


@query()
def shuffled_slot_batches(spark, d):
    sents = base.hashed_documents(spark, d, "source")
    out = batching.shuffled_batches(sents, "source", "doc_id", "ids", 4, 32)
    return out.select("shard", "batch_id", "b", F.array_join("input", " ").alias("input"), F.array_join("target", " ").alias("target"))


_LEN = "('0x' || substr(md5('0|{}|' || k), 1, 8))::BIGINT / 4294967296.0"


@query(f"""WITH {base.sql_ids()}, n AS (SELECT count(*) // 16 AS n_step FROM ids),
sz AS (SELECT k, least(79, greatest(5, CAST(trunc(CASE WHEN {_LEN.format('base')} < 0.95 THEN 64.0::DOUBLE ELSE 32.0::DOUBLE END + 5 * (sqrt(-2 * ln(1 - {_LEN.format('n1')})) * cos(2 * pi() * {_LEN.format('n2')}))) AS BIGINT))) AS s FROM range((SELECT n_step // 5 + 1 FROM n)) r(k)),
bd AS (SELECT k, s, coalesce(sum(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM sz), bb AS (SELECT k, beg, beg + least(s, n_step - 1 - beg) AS last FROM bd, n WHERE beg < n_step - 2),
placed AS (SELECT gpos % n_step AS t, gpos // n_step AS b, token_id FROM ids, n WHERE gpos < n_step * 16)
SELECT CAST(k AS INTEGER) AS batch_id, CAST(b AS INTEGER) AS b, array_to_string(list(token_id ORDER BY t) FILTER (t < last), ' ') AS input, array_to_string(list(token_id ORDER BY t) FILTER (t > beg), ' ') AS target FROM placed JOIN bb ON t >= beg AND t <= last GROUP BY 1, 2""")
def variable_bptt(spark, d):
    n = base.n_tokens(spark, d)
    out = windows.variable(base.encoded_documents(spark, d), "ids", n, 16, batching.variable_bounds(spark, n // 16, 64))
    return out.select("batch_id", "b", F.array_join("input", " ").alias("input"), F.array_join("target", " ").alias("target"))


@query()
def regime_batches(spark, d):
    docs = base.hashed_documents(spark, d).withColumnRenamed("ids", "token_ids")
    return base.union([combinators.regime(docs, kind, 4, 128).select(F.lit(kind).alias("kind"), F.col("batch_id").cast("long").alias("batch_id"), F.col("row_id").cast("int").alias("row_id"), F.array_join("token_ids", " ").alias("token_ids")) for kind in ("doc", "semidoc", "sent")])
