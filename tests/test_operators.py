"""Worked examples and invariants of single operators."""

import hashlib
import random

import numpy as np
import pytest
from corploom.functions import arrays, tokenizers
from corploom.functions import text as tx
from corploom.operators import batching, edits, packing, positions, renorm, spans, vocab
from corploom.plans import examples
from corploom.sources import records, sinks
from corploom.sources import text as source
from corploom.streaming import state
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(a):
    return F.array(*map(F.lit, a))


def test_packing_example(spark):
    df = spark.createDataFrame([(0, [8, 7, 1], [4, 1]), (1, [2, 3, 4, 1], [5, 6, 1])], "i long, source array<int>, target array<int>")
    r = packing.pack(df, 10, ["source", "target"], "i").first()
    assert r["source"] == [8, 7, 1, 2, 3, 4, 1, 0, 0, 0] and r["source_segmentation"] == [1, 1, 1, 2, 2, 2, 2, 0, 0, 0] and r["source_position"] == [0, 1, 2, 0, 1, 2, 3, 0, 0, 0]
    assert r["target"][:5] == [4, 1, 5, 6, 1] and r["target_segmentation"][:6] == [1, 1, 2, 2, 2, 0] and r["target_position"][:5] == [0, 1, 0, 1, 2]


def test_queue_keeps_every_item_within_capacity():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(rng.randint(0, 80))]
        bins = packing.queue_bins(lengths, 40)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i][k] for i in b) <= 40 for b in bins for k in (0, 1))


def test_long_items(spark):
    df = spark.createDataFrame([(0, [1] * 12), (1, [2] * 3)], "i long, a array<int>")
    assert [r["a"][:4] for r in packing.pack(df, 10, ["a"], "i").collect()] == [[2, 2, 2, 0]]
    assert sorted(len([t for t in r["a"] if t]) for r in packing.pack(df, 10, ["a"], "i", "chop").collect()) == [3, 10]


def test_overlapping_windows(spark):
    stream = spark.range(7).select(F.col("id").alias("gpos"), F.col("id").alias("token_id"))
    assert sorted(tuple(r["inputs"] + [r["target"][-1]]) for r in batching.overlapping(stream, 2).collect()) == [(0, 1, 2), (2, 3, 4), (4, 5, 6)]


def test_shifted_positions(spark):
    seg = [1, 1, 1, 2, 2, 2, 0]
    assert one(spark, packing.shift_target_position(lit([0, 1, 2, 0, 1, 2, 0]), lit(seg), lit(seg))) == [3, 4, 5, 3, 4, 5, 0]


def test_target_rotation(spark):
    s, pad = 1, 0
    x = [s, 11, 12, 13, s, 21, 22, s, 31, 32, pad, pad]
    target, mask = arrays.shifted_target(lit(x), lit([1] * 10 + [0, 0]), pad, s)
    assert one(spark, target) == [11, 12, 13, s, 21, 22, s, 31, 32, s, s, s] and one(spark, mask) == [1] * 10 + [0, 0]


def test_word_pieces(spark):
    assert tokenizers.longest_pieces("unaffable", {"un": 0, "##aff": 1, "##able": 2}) == ["un", "##aff", "##able"]
    assert tokenizers.longest_pieces("unaffablex", {"un": 0, "##aff": 1, "##able": 2}) == ["<unk>"] and tokenizers.longest_pieces("a" * 201, {"a": 0}) == ["<unk>"]
    df = spark.createDataFrame([("Unaffable, ÚN!",), (None,)], "t string")
    got = [r["p"] for r in df.select(tokenizers.full_tokenizer(F.col("t"), ["un", "##aff", "##able", ",", "!"]).alias("p")).collect()]
    assert got == [["un", "##aff", "##able", ",", "un", "!"], None]


def test_document_reader(spark):
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(["a b", "", "c", "", " ", "d e"])], "path string, line_no long, line string")
    assert sorted(r["sents"] for r in source.documents(rows, min_doc_len=2).collect()) == [[["a", "b"]], [["d", "e"]]]


def test_articles(spark):
    text = ["", " = A = ", "", "x", "", " = B = ", "", " = = C = = ", "y"]
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(text)], "path string, line_no long, line string")
    assert [r["article"] for r in source.articles(rows).orderBy("line_no").collect()] == [1, 1, 1, 1, 2, 2, 2, 2, 2]


def test_text_files(spark, tmp_path):
    for name, body in (("b.txt", "x y\n\nz"), ("a.txt", "\n".join(map(str, range(500))))):
        (tmp_path / name).write_text(body)
    got = source.lines(spark, f"{tmp_path}/*.txt").orderBy("file_idx", "line_no").collect()
    assert [(r["file_idx"], r["line_no"], r["line"]) for r in got] == [(1, k, str(k)) for k in range(500)] + [(2, 0, "x y"), (2, 1, ""), (2, 2, "z")]


def test_pairs_and_char_split(spark):
    rows = spark.createDataFrame([(0, "a\tb"), (1, "a\t"), (2, "a"), (3, "a\tb\tc")], "line_no long, line string")
    assert [(r["source"], r["target"]) for r in source.pairs(rows).orderBy("line_no").collect()] == [("a", "b"), ("a", "")]
    train, valid, test = source.fixed_char_split(F.lit("ab cd efg hi"), 3)
    assert [one(spark, c) for c in (train, valid, test)] == ["a b _ c d", "e f g", "h i"]


def test_ordered_batches(spark):
    stream = spark.range(11).select(F.col("id").alias("gpos"), F.col("id").alias("token_id"))
    got = {(r["batch_id"], r["b"]): (r["input"], r["target"]) for r in batching.ordered_batches(stream, 11, 2, 2).collect()}
    assert got == {(0, 0): ([0, 1], [1, 2]), (0, 1): ([5, 6], [6, 7]), (1, 0): ([2, 3], [3, 4]), (1, 1): ([7, 8], [8, 9])}
    ext = {(r["batch_id"], r["b"]): r["input"] for r in batching.ordered_batches(stream, 11, 2, 2, ext_len=1).collect()}
    assert ext == {(0, 0): [0, 1], (0, 1): [5, 6], (1, 0): [1, 2, 3], (1, 1): [6, 7, 8]}
    assert batching.pass_start(11, 2, 0) == batching.pass_start(11, 2, 1) == 0


def test_slot_batches():
    got = list(batching.slot_batches([[1, 2, 3], [4, 5], [6, 7, 8, 9], [10, 11]], 2, 2))
    assert got == [([[1, 2], [4, 6]], [[2, 3], [5, 7]])]


def test_vocabulary_ties(spark):
    tokens = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c"), (3, "a"), (4, "b")], "gpos long, token string")
    v = vocab.build_vocab(vocab.token_counts(tokens), ["<eos>"])
    assert {r["token"]: r["token_id"] for r in v.collect()} == {"<eos>": 0, "b": 1, "a": 2, "c": 3}
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocab.encode_strict(spark.createDataFrame([("q",)], "token string"), v).collect()
    assert vocab.special_ids(spark.createDataFrame([("<unk>", 0), ("<mask>", 5), ("<ph_id_0>", 9)], "token string, token_id int")) == vocab.SpecialIds(unk=0, mask=5, placeholder_0=9)


def test_offsets_do_not_depend_on_ranges(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k * 3, rng.randint(0, 5), k % 2) for k in range(400)], "k long, n long, lane int")
    for by in ((), ("lane",)):
        a = positions.offsets(df, "k", "n", by).collect()
        b = positions.offsets(df, "k", "n", by, ranges=7, small=10).collect()
        assert sorted(map(str, a)) == sorted(str(r) for r in b)


def test_edit_noise():
    assert edits.redundant(5, [], [1], [1])
    assert edits.redundant(5, [2], [], [2]) and edits.redundant(5, [2], [1], []) and edits.redundant(5, [2], [2], []) and not edits.redundant(5, [2], [4], [0])
    import numpy as np

    for seed in range(50):
        ids = list(range(100, 130))
        enc, enc_label, dec, dec_label = edits.noise(ids, 0.2, np.random.default_rng(seed), 3, 4)
        assert [t for t, x in zip(dec, dec_label, strict=True) if x != 1] == ids
        assert [t for t, x in zip(enc, enc_label, strict=True) if x == 0] == [t for t, x in zip(dec, dec_label, strict=True) if x == 0]
        assert sum(x > 0 for x in dec_label) == 6 and sum(x == 2 for x in dec_label) == len(dec) - len(enc)


def test_relative_shift(spark):
    x = [[10 * i + j for j in range(6)] for i in range(3)]
    assert one(spark, arrays.rel_shift(F.array(*map(lit, x)))) == [[x[i][j + 3 - i] for j in range(3)] for i in range(3)]
    assert one(spark, arrays.rel_shift(F.array(*map(lit, x)), padded=True)) == [[x[i][j + 2 - i] for j in range(4)] for i in range(3)]


def test_masks_have_the_asked_number_of_places(spark):
    seqs = examples.sequences(spark, SF)
    rows = spans.places(seqs)
    topped = spans.span_mask_topped_up(rows, spans.sample_spans(seqs, examples.L, examples.P), examples.P, examples.EOS)
    for masked in (spans.single_token_mask(rows, examples.P, examples.EOS), topped):
        got = masked.where("is_masked").groupBy("seq_id").agg(F.count("*").alias("n"), F.min(F.col("token_id")).alias("t")).collect()
        assert len(got) == seqs.count() and all(r["n"] == examples.P and r["t"] != examples.EOS for r in got)
    for law in (spans.MLM, spans.MASS, spans.SENTINEL, spans.EDIT):
        by = {}
        for r in spans.sample_spans(seqs, examples.L, examples.P, law).collect():
            by.setdefault(r["seq_id"], []).append((r["beg"], r["end"]))
        for s in by.values():
            s.sort()
            assert all(0 <= a < b <= examples.L for a, b in s) and all(x[1] <= y[0] for x, y in zip(s, s[1:], strict=False))


def test_sentinels_and_edits_can_be_undone(spark):
    originals = {r["seq_id"]: list(r["token_ids"]) for r in examples.sequences(spark, SF).collect()}
    # no place is an end mark here: one inside a span stays in the source, behind the placeholder
    masked = spans.mask_spans(examples.typed(spark, SF), examples.given_spans(spark, SF), examples.P, -1)
    for r in spans.sentinel_examples(masked, examples.L, examples.P, 2000, examples.EOS).collect():
        parts, k = {}, None
        for t in r["target"][: sum(r["target_segmentation"])]:
            if t >= 2000:
                k = t
                parts[k] = []
            else:
                parts[k].append(t)
        undone = [x for t in r["source"] if t for x in (parts[t] if t >= 2000 else [t])]
        assert undone == originals[r["seq_id"]]
    spec = edits.EditSpec(enc_len=200, dec_len=200)
    ops = edits.sample_edits(examples.typed(spark, SF), examples.L, spec, 5)
    for r in edits.edit_examples(ops, spec).collect():
        assert [t for t, x in zip(r["dec_tgt"], r["edit_label"], strict=True) if x != spec.ins_label and t != spec.pad_id] == originals[r["seq_id"]]
        enc = [t for t, x, m in zip(r["gen_inp"], r["enc_edit_label"], r["enc_mask"], strict=True) if x == 0 and not m]
        assert enc == [t for t, x, m in zip(r["dec_tgt"], r["edit_label"], r["dec_mask"], strict=True) if x == 0 and not m]
        assert sum(r["gen_tgt_mask"]) == sum(x == spec.rep_label for x in r["edit_label"])


def test_next_type(spark):
    assert one(spark, edits.next_type(lit([1, 3, 4]), lit([7, 8, 9]), 7)) == [7, 7, 8, 8, 9, 0, 0]


def test_records_round_trip(spark, tmp_path):
    assert records.masked_crc(b"123456789") == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    rows = [([1, 2, -3], [0]), ([2**40], [1]), ([], [2])]
    data = b"".join(records.record_bytes(records.example_bytes({"inputs": a, "type_id": b})) for a, b in rows)
    (tmp_path / "x.tfrecord").write_bytes(data)
    got = records.read_records(spark, f"{tmp_path}/x.tfrecord", records.SENTENCE).collect()
    assert [(list(r["inputs"]), list(r["type_id"])) for r in got] == rows
    with pytest.raises(ValueError, match="checksum"):
        list(records.records_of(data[:-1] + b"\x00"))
    spark.dataSource.register(records.RecordSource)
    out = f"{tmp_path}/out"
    spark.createDataFrame(rows, records.SENTENCE).write.format("records").mode("append").save(out)
    again = records.read_records(spark, f"{out}/*.tfrecord", records.SENTENCE).collect()
    assert sorted((list(r["inputs"]), list(r["type_id"])) for r in again) == sorted(rows)


def test_store_and_names(spark, tmp_path):
    rows = spark.createDataFrame([([1, 2], [0])], records.SENTENCE)
    sinks.write_store(rows, f"{tmp_path}/s", "train", "sent", True)
    sinks.write_store(rows, f"{tmp_path}/s", "valid", "doc", True)
    assert records.store(spark, f"{tmp_path}/s", "train", ("sent",), True).count() == 1 and records.store(spark, f"{tmp_path}/s", "valid", ("semidoc",), True).count() == 1
    assert one(spark, records.shard_name("train", "tfrecord", F.lit(3), 10, True)) == "train.uncased.tfrecord-00003-of-00010"
    assert records.parsed(rows).first()["type_id"] == [0, 0]
    with pytest.raises(Exception, match="3 places"):
        records.fixed(rows, 3, ("inputs",)).collect()


def test_text_functions(spark):
    assert one(spark, tx.words(F.lit(" a b\x1cc \n"))) == ["a", "b", "c"] and one(spark, tx.words(F.lit("  "))) == []
    assert one(spark, tx.frame(lit([5]), 1, True, True)) == [1, 5, 1] and one(spark, tx.tokenize_line(F.lit(" a b "), "", add_eos=True)) == ["a", " ", "b", "<eos>"]
    assert one(spark, tx.basic_tokens(F.lit("Ab,c漢x\x00 d"))) == ["ab", ",", "c", "漢", "x", "d"]
    assert one(spark, tokenizers.preprocess(F.lit("  ``É’ x"), lower=True)) == "\"e' x"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, tx.integer_tokens(F.lit("1 x")))
    with pytest.raises(ValueError):
        tokenizers.tokenizer("none")


def test_renormalisation_by_ends(spark):
    words = spark.createDataFrame([("ab", [1, 2]), ("c", [3])], "word string, pieces array<int>")
    inputs = spark.createDataFrame([(0, t, x) for t, x in enumerate([1, 2, 1, 2, 3])], "b int, t int, input int")
    got = {}
    for r in renorm.allowed_next_by_end(inputs, words).collect():
        got.setdefault(r["t"], set()).add(None if r["any_token"] else r["next_token"])
    assert got == {0: {None}, 1: {None}, 2: {2}, 3: {1, 3}, 4: {1, 3}}


def test_memory_stream(spark, tmp_path):
    rows = [(k % 2, k, k * 10) for k in range(8)]
    for n in (0, 1):
        spark.createDataFrame(rows[4 * n : 4 * n + 4], "s int, t int, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("s int, t int, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = state.memory_stream(stream, "s", "t", "v", 2).writeStream.format("memory").queryName("mem").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["t"]: list(r["memory"]) for r in spark.table("mem").collect()}
    assert got == {t: [x * 10 for x in range(t % 2, t, 2)][-2:] for t in range(8)}


def test_windows_of_arrays_are_those_of_rows(spark):
    from corploom.operators import windows

    rng = random.Random(6)
    for sizes in ([3, 0, 1, 17, 2, 9, 5], [40], [0, 1]):
        rows = [(k * 2, [rng.randrange(100) for _ in range(n)]) for k, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "k long, ids array<int>")
        placed, stream = windows.with_offsets(df, "k", "ids"), positions.stream_positions(df, "k", "ids", "token_id")
        n, same = sum(sizes), lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        assert same(windows.chunks(placed, "ids", 4, 1), batching.chunk(stream, 4, eos=1).select("seq_no", "token_id"))
        assert same(windows.overlapping(placed, "ids", 4), batching.overlapping(stream, 4))
        for bsz, steps in ((2, 4), (3, 2), (1, 100)):
            assert same(windows.ordered(placed, "ids", n, bsz, steps), batching.ordered_batches(stream, n, bsz, steps).select("batch_id", "b", "input", "target"))


def test_prefixes_and_windows_of_streams(spark, tmp_path):
    rows = [(0, t, x) for t, x in enumerate([9, 1, 5, 6, 2, 7])]
    for n in (0, 1):
        spark.createDataFrame(rows[3 * n : 3 * n + 3], "b int, t int, x int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("b int, t int, x int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = state.prefix_stream(stream, "b", "t", "x", [1, 2]).writeStream.format("memory").queryName("pre").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["t"]: r["prefix"] for r in spark.table("pre").collect()}
    assert got == {0: None, 1: [1], 2: [1, 5], 3: [1, 5, 6], 4: [2], 5: [2, 7]}
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts, double(id) AS v FROM range(30)").coalesce(1).write.parquet(f"{tmp_path}/ev")
    ev = spark.readStream.schema("ts timestamp, v double").parquet(f"{tmp_path}/ev")
    q = state.loss_windows(ev, "ts", "v").writeStream.format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/cp2").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    closed = sorted((r["window"]["start"].minute, r["mean_value"], r["n"]) for r in spark.table("win").collect())
    assert closed[:2] == [(0, 2.0, 5), (5, 7.0, 5)] and all(n == 5 for _, _, n in closed)


def test_permutation_streams_and_masks(spark):
    """Nested loops over places: the key stream is the original, leaked places are seen like context, random ones stay hidden."""
    seqs = spark.createDataFrame([(s, [5 + (s * 7 + k) % 50 if k % 10 != 9 else 1 for k in range(60)]) for s in range(12)], "seq_id long, token_ids array<int>")
    rows = spans.corrupt(spans.single_token_mask(spans.places(seqs), 20, 1), 3, 1000, leak=0.3, rand=0.3).cache()
    out = spans.permutation_examples(rows, 20, leak=0.3)
    out = out.withColumn("mask_k", spans.perm_mask(F.col("perm_index"), False)).withColumn("mask_q", spans.target_perm_mask(F.col("perm_index"), F.col("target_index"), True)).collect()
    by = {}
    for r in rows.orderBy("pos").collect():
        by.setdefault(r["seq_id"], []).append(r)
    kinds = set()
    for r in out:
        places = by[r["seq_id"]]
        u = [int(hashlib.md5(f"0|corrupt|{p['seq_id']}|{p['pos']}".encode()).hexdigest()[:8], 16) / 2**32 for p in places]
        assert r["input_k"] == [p["token_id"] for p in places] and r["input_q"] == [p["masked_input"] for p in places]
        assert r["target"] == [p["token_id"] for p in places if p["is_masked"]] and r["target_index"] == [p["pos"] for p in places if p["is_masked"]]
        hidden = [p["is_masked"] and x > 0.3 for p, x in zip(places, u, strict=True)]
        assert [i >= 0 for i in r["perm_index"]] == hidden
        for p, x, h in zip(places, u, hidden, strict=True):
            if h:
                kinds.add(x < 0.6)
                assert (p["masked_input"] != 3) == (x < 0.6) or p["masked_input"] == 3
        order = [int(hashlib.md5(f"0|perm|{p['seq_id']}|{p['pos']}".encode()).hexdigest()[:8], 16) for p in places]
        for i in range(60):
            for j in range(60):
                assert r["mask_k"][i][j] == int(hidden[j] and not (hidden[i] and order[j] <= order[i]))
        for at, i in enumerate(r["target_index"]):
            for j in range(60):
                assert r["mask_q"][at][j] == int(hidden[j] and not (hidden[i] and order[j] < order[i]))
    assert kinds == {True, False}


def test_span_edits_by_loops(spark):
    n, spec = 128, edits.EditSpec()
    seqs = spark.createDataFrame([(s, [10 + k if k % 17 != 16 else 1 for k in range(n)]) for s in range(40)], "seq_id long, token_ids array<int>")
    found = spans.sample_spans(seqs, n, 20, spans.EDIT).cache()
    got = {}
    for r in edits.sample_span_edits(spans.places(seqs).withColumn("type_id", F.lit(0)), found, n, spec).orderBy("pos").collect():
        got.setdefault(r["seq_id"], []).append(r)
    u = lambda tag, *key: int(hashlib.md5("|".join(map(str, (0, tag, *key))).encode()).hexdigest()[:8], 16) / 2**32
    inserted = 0
    for s, places in got.items():
        kind = [None] * n
        for r in found.where(F.col("seq_id") == s).collect():
            for p in range(r["beg"], r["end"]):
                if places[p]["token_id"] != 1:
                    kind[p] = "d" if u("kind", s, r["span_rank"]) < 0.5 else "r"
        free = [p for p in range(n) if kind[p] is None and (p == 0 or kind[p - 1] is None) and places[p]["token_id"] != 1]
        want, total = [0] * n, 0
        for p in sorted(free, key=lambda p: (u("run_at", s, p), p)):
            size = int(u("run", s, p) * 5) + 1
            total += size
            if total >= 13:
                break
            want[p] = size
        assert [r["n_ins"] for r in places] == want and [r["is_del"] for r in places] == [k == "d" for k in kind] and [r["is_rep"] for r in places] == [k == "r" for k in kind]
        inserted += sum(want)
    assert inserted


def test_slot_batches_by_queues():
    """Slots that pull sentences one by one give the same batches."""
    rng = random.Random(3)
    for _ in range(60):
        sents = [[rng.randrange(99) for _ in range(rng.choice([1, 1, 2, 3, 9, 30]))] for _ in range(rng.randint(0, 40))]
        bsz, bptt, ext = rng.randint(1, 4), rng.randint(1, 6), rng.randint(0, 5)
        stream, queues = [s for s in sents if len(s) > 1], [[] for _ in range(bsz)]
        history, want, alive = [[] for _ in range(bsz)], [], True
        while alive:
            batch = []
            for q, old in zip(queues, history, strict=True):
                while alive and len(q) < bptt:
                    if stream:
                        s = stream.pop(0)
                        q += list(zip(s, s[1:], strict=False))
                    else:
                        alive = False
                if alive:
                    step = [q.pop(0) for _ in range(bptt)]
                    batch.append(([x for x, _ in old[len(old) - min(ext, len(old)) :] + step], [y for _, y in step]))
                    old += step
            if alive:
                want.append(([x for x, _ in batch], [y for _, y in batch]))
        assert list(batching.slot_batches(sents, bsz, bptt, ext)) == want


def test_recall_of_lists(spark):
    """The registered index finds at least nine of ten true neighbours."""
    from corploom.plans import evaluation

    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        near = {(r["query_id"], r["vec_id"]) for r in evaluation.QUERIES["knn_topk"](spark, d).collect()}
        found = {(r["query_id"], r["vec_id"]) for r in evaluation.QUERIES["knn_ivf"](spark, d).collect()}
        assert len(near & found) >= 0.9 * len(near)


def _machine(stream, words, specials, by_end):
    """What may come after each piece, by the sequential machine over a trie: None for anything, a set otherwise."""
    trie, heads, ends = {}, set(specials), set(specials)
    for w in words:
        node = trie
        for x in w:
            node = node.setdefault(x, {})
        for s in specials:
            node.setdefault(s, {})
        heads.add(w[0])
        ends.add(w[-1])
    for s in specials:
        trie[s] = {w[0]: {} for w in words}
    node, out, inside = None, [], False
    for x in stream:
        if not by_end and x in heads:
            node, inside = trie, True
        if not inside:
            out.append(None)
            if by_end and x in ends:
                node, inside = trie, True
            continue
        node = node.get(x, {}) if node is not None else {}
        out.append(set(node) | (heads if x in ends else set()))
        if by_end and x in ends:
            node = trie
    return out


@pytest.mark.parametrize("by_end", [False, True])
@pytest.mark.parametrize("specials", [[], [90, 91]])
def test_renormalisation_in_blocks_is_the_sequential_machine(spark, by_end, specials):
    rng = random.Random(9)
    words = list({(rng.randrange(8), *[rng.randrange(10, 16) for _ in range(rng.randrange(4))]) for _ in range(40)})
    if by_end:
        words = [w[::-1] for w in words]
    streams = {}
    for b, n in enumerate((1, 2, 37, 400, 1500)):
        made = [rng.randrange(10, 16) for _ in range(3)] if b % 2 else []
        while len(made) < n:
            made += rng.choice([rng.choice(words), rng.choice(words), rng.choice(words), [rng.randrange(10, 16)] * rng.randrange(9), [rng.choice([*specials, 12])]])
        streams[b] = made[:n]
    df = spark.createDataFrame([(f"w{k}", list(map(int, w))) for k, w in enumerate(words)], "word string, pieces array<int>")
    inputs = spark.createDataFrame([(b, t, x) for b, s in streams.items() for t, x in enumerate(s)], "b int, t int, input int").repartition(3)
    flag = renorm.flags(df, specials)
    by_key, dictionary = renorm.numbered_sets(df, flag, specials)
    longest = renorm._longest(df)
    for size in (1, 16, 10_000):
        cut = renorm.blocks(inputs, flag, longest + 1, by_end, size)
        rows = renorm.candidates(renorm.run_keys(cut, flag, longest, by_end), by_key, flag).join(dictionary, "set_id", "left").collect()
        got = {(r["b"], r["t"]): None if r["allowed"] is None else set(r["allowed"]) for r in rows}
        assert len(rows) == len(got)
        for b, s in streams.items():
            assert [got[b, t] for t in range(len(s))] == _machine(s, words, specials, by_end)
    arrays = spark.createDataFrame(list(streams.items()), "b int, ids array<int>")
    same = renorm.candidates(renorm.run_keys(renorm.array_blocks(arrays, "ids"), flag, longest, by_end), by_key, flag).join(dictionary, "set_id", "left").collect()
    assert {(r["b"], r["t"]): None if r["allowed"] is None else set(r["allowed"]) for r in same} == got
    assert {(r["b"], r["t"]): r["target"] for r in same} == {(b, t): (s[t + 1] if t + 1 < len(s) else None) for b, s in streams.items() for t in range(len(s))}


def test_bitmaps_are_the_sets(spark):
    rows = [(1, []), (2, [0]), (3, [0, 7, 8, 70000]), (4, [32767, 32768, 65535])]
    got = {r["set_id"]: np.flatnonzero(np.unpackbits(np.frombuffer(r["bitmap"], dtype=np.uint8), bitorder="little")).tolist() for r in renorm.bitmaps(spark.createDataFrame(rows, "set_id long, allowed array<int>"), 70001).collect()}
    assert got == dict(rows)
    assert {len(r["bitmap"]) for r in renorm.bitmaps(spark.createDataFrame(rows[:2], "set_id long, allowed array<int>"), 9).collect()} == {2}


def test_sparse_gradients_equal_the_dense_mean(spark):
    from corploom.operators import metrics

    rng = random.Random(3)
    dense = {(t, v, i): float(rng.randrange(1, 9)) if rng.random() < 0.3 else 0.0 for t in range(5) for v in ("a", "b") for i in range(20)}
    rows = [(t, v, i, x) for (t, v, i), x in dense.items() if x] + [(0, "a", 3, 2.0), (0, "a", 3, 5.0)]
    dense[0, "a", 3] += 7.0
    got = {(r["var_name"], r["idx"]): r["grad"] for r in metrics.sparse_gradient_average(spark.createDataFrame(rows, "tower int, var_name string, idx int, grad double"), 5).collect()}
    want = {(v, i): sum(dense[t, v, i] for t in range(5)) / 5 for v in ("a", "b") for i in range(20)}
    assert {k: x for k, x in want.items() if x} == pytest.approx(got)
    counted = metrics.sparse_gradient_average(spark.createDataFrame([(0, "a", 1, 2.0), (1, "a", 2, 4.0), (7, "b", 1, 3.0)], "tower int, var_name string, idx int, grad double")).collect()
    assert {(r["var_name"], r["idx"]): r["grad"] for r in counted} == {("a", 1): 1.0, ("a", 2): 2.0, ("b", 1): 3.0}
