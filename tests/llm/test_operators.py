"""Training-data operators against plain walks on small and awkward inputs."""

import random
import unicodedata

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from tallyweave.llm import ledger, packing, splitting, tokens, topn

BYTE = "byte_bpe_50k"


def _texts():
    rng = random.Random(3)
    bits = ["the ", "A130V+", "é", "日本", "🙂", " ", "  ", "\n\n", "\t", "'s", "12", "==", "ACDEFGHIK", "<|endoftext|>", "\x1c", "\xa0", "don't ", "Ünïcode. ", "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 120))) for _ in range(150)]


def test_encoding_equals_the_library():
    encoder = tokens.load(BYTE)
    for text in [*_texts(), " " * 3000, "a" * 40_000, "é" * 20_000, ("x" * 50 + " ") * 9000]:
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == encoder.core.encode_ordinary(text)


def test_streaming_is_exact_in_any_blocks():
    encoder, rng = tokens.ByteEncoder(tokens.TOKENIZERS, BYTE), random.Random(4)
    cases = [*_texts(), " " * 900 + "x", "\n" * 700, "A" * 2000 + "1", "=" * 1500, "-a" * 600, "日" * 900, "reinterpretation" * 90, "'ll" * 400]
    for text in cases:
        for most in (3, 400, 3000):
            out, i = [], 0
            stream = tokens.ByteStream(encoder, out)
            while i < len(text):
                step = rng.randrange(1, most)
                stream.push(text[i : i + step])
                i += step
            stream.finish()
            assert encoder.resolved(out)[0].tolist() == encoder.core.encode_ordinary(text), ascii(text[:50])


def test_streaming_keeps_little_and_emits_early():
    """What waits is bounded, and ids come out before the text ends, in words, runs of one split and runs of many splits."""
    encoder = tokens.load(BYTE)
    for unit in ("word ", "MKTAYIAKQR", "a1-", "日本語、", "é"):
        out, most = [], 0
        stream = tokens.ByteStream(encoder, out)
        text = unit * 12_000
        for i in range(0, len(text), 1000):
            stream.push(text[i : i + 1000])
            most = max(most, len(stream.rest) + len(stream.open))
        assert most < 8000 and len(encoder.resolved(out)[0]) > 0, (unit, most)
        stream.finish()
        assert encoder.resolved(out)[0].tolist() == encoder.core.encode_ordinary(text)


def test_every_text_of_the_query_goes_through_the_transducer(monkeypatch):
    pushed, finished = [], []
    push, finish = tokens.ByteStream.push, tokens.ByteStream.finish
    monkeypatch.setattr(tokens.ByteStream, "push", lambda self, block: (pushed.append(len(block)), push(self, block))[1])
    monkeypatch.setattr(tokens.ByteStream, "finish", lambda self: (finished.append(1), finish(self))[1])
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).combine_chunks()
    lists = [x for ids in tokens.id_lists(texts, BYTE) for x in ids.to_pylist()]
    assert len(lists) == len(texts) == len(finished) and sum(pushed) == sum(len(t) for t in texts.to_pylist() if t)
    core = tokens.load(BYTE).core
    assert lists == [core.encode_ordinary(t or "") for t in texts.to_pylist()]


def test_stretches_are_read_alike_alone_and_in_their_text():
    rng, byte, word = random.Random(8), tokens.load(BYTE), tokens.load("word_bpe_49k")
    bits = ["'s", "'S", "don't", "!'re", "''ll", "'é", " ", "  ", "\n", "\t ", "\xa0", "\u3000", "\x1c", "\x85", "12", "A1", "_", "é", "e\u0301", "h\u0331", "H\u0331", "İ", "日本", "🙂", "-", "'", "\u200b"]
    texts = ["", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(400)), *_texts()]
    cut = tokens.Stretches(texts)
    assert "".join(cut.keys[i] for i in cut.number) == "".join(texts)
    ids, counts = byte.runs(cut)
    assert ids.tolist() == [i for t in texts for i in byte.core.encode_ordinary(t)]
    assert tokens.sums(counts, cut.per_text).tolist() == [len(byte.core.encode_ordinary(t)) for t in texts]
    found = [word.model.encode(t, add_special_tokens=False) for t in texts]
    starts, ends, count = word.places(cut)
    assert count.tolist() == [len(f.ids) for f in found] and (starts <= ends).all() and (ends[:-1] <= starts[1:]).all()
    at = np.cumsum([0, *map(len, texts)])
    for i, f in enumerate(found):
        for (a, b), s, e in zip(f.offsets, starts[count[:i].sum() :].tolist(), ends[count[:i].sum() :].tolist()):
            assert s - at[i] <= a or s == e, (ascii(texts[i]), a, s - at[i])
            assert e - at[i] >= b or s == e, (ascii(texts[i]), b, e - at[i])


def test_tables_forget_and_stay_right(monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBER", 50)
    encoder = tokens.WordEncoder(tokens.TOKENIZERS, "word_bpe_49k")
    for text in _texts():
        assert encoder.count(text) == len(encoder.model.encode(text, add_special_tokens=False).ids)
        assert encoder.table.size < 400


def test_decoding_keeps_split_characters():
    encoder = tokens.load(BYTE)
    for text in _texts():
        ids, decoder = np.frombuffer(encoder.encode(text), np.int32).tolist(), tokens.Decoder(encoder)
        assert "".join([*(decoder.push([i]) for i in ids), decoder.finish()]) == text


def test_counts_equal_the_libraries():
    piece, word = tokens.load("piece_bpe_32k"), tokens.load("word_bpe_49k")
    assert piece.separable
    for text in [*_texts(), "a  b\n c", " ", "  x"]:
        assert piece.count(text) == len(piece.model.encode(text)), ascii(text)
        starts, ends = word.spans(text)
        assert word.count(text) == len(starts) == len(word.model.encode(text, add_special_tokens=False).ids), ascii(text)
        assert (starts <= ends).all() and (ends[:-1] <= starts[1:]).all()


def test_encoding_frame(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "hi <|endoftext|>", "c")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], len(r["ids"])) for r in tokens.encode_corpus(df, "doc_id", "text").collect())
    assert got[:2] == [(1, 0), (2, 0)] and got[2][1] > 3
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    back = tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted(r["text"] for r in back.collect()) == ["", "", "hi <|endoftext|>"]


@pytest.mark.parametrize("heavy_from", [5, 10**9])
def test_top_items(spark, heavy_from):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *(f"m{i}" for i in range(60))]), float(rng.randrange(4)) * rng.choice([1, -1]), rng.randrange(3)) for _ in range(2000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, m string, v double, i int, pos int")
    got = {}
    for r in topn.top_items(df, "g", "m", ["v", "i"], 5, heavy_from).collect():
        got.setdefault(r["g"], {})[r["pos"]] = r["m"]
    for g in ("hot", "a", "b"):
        best = {}
        for g2, m, v, i in rows:
            if g2 == g and m is not None:
                best[m] = min(best.get(m, (9.0, 9)), (v, i))
        want = sorted(best, key=lambda m: (*best[m], m))[:5]
        assert [got[g][p] for p in range(1, 6)] == want
    assert set(got) == {"hot", "a", "b"} and topn.top_items(df.limit(0), "g", "m", ["v"], 5).count() == 0


def test_top_items_with_nulls_in_the_order(spark):
    """Nulls come first in every order column; an item stands where its best row stands."""
    rng = random.Random(6)
    rows = [("g", f"m{rng.randrange(12)}", rng.choice([None, 1.0, 2.0, -1.0]), rng.choice([None, 0, 1, 2])) for _ in range(60)]
    key = lambda v, i: ((v is not None, v or 0.0), (i is not None, i or 0))
    best = {}
    for _, m, v, i in rows:
        best[m] = min(best.get(m, key(9.0, 9)), key(v, i))
    want = sorted(best, key=lambda m: (*best[m], m))[:6]
    df = spark.createDataFrame(rows, "g string, m string, v double, i int")
    for heavy_from in (3, 10**9):
        got = {r["pos"]: r["m"] for r in topn.top_items(df, "g", "m", ["v", "i"], 6, heavy_from).collect()}
        assert [got[p] for p in range(1, 7)] == want


RECORDS = [
    (1, "Q_1", "A15Y:K3L"), (2, "q-1 ", "p.k3l + P. A-15-Y"), (3, "Q1", "(K 3 L)、[a15y]"), (4, "Q1", "A15Y"), (5, "Q2", "A15Y:K3L"), (6, "Q1", None), (7, "Q1", "  \n"),
    (8, "Q1", "..."), (9, "Q1", "-"), (10, None, "A15Y"), (11, "Q1", "WT A15Y"), (12, "Q1", "a15y WT"), (13, "Q1", "w.t:A15Y"), (14, "Q1", "A15P.K3L"), (15, "Q1", "A15P,p.K3L"), (16, "Q1", "A15Y:A15Y"),
]


def test_copies(spark):
    df = spark.createDataFrame([(*r, None if r[0] == 3 else r[0], "x") for r in RECORDS], "rec_id bigint, query_id string, original string, t int, n string")
    df = df.selectExpr("rec_id", "query_id", "original", "timestamp_seconds(t * 100000) AS received_at", "n")
    got = sorted((r["keep_id"], r["dup_id"]) for r in ledger.copies(df).collect())
    assert got == [(1, 2), (1, 3), (8, 9), (11, 13), (14, 15)]
    counts = {r["keep_id"]: r["n_copies"] for r in ledger.collapsed(df).collect()}
    assert counts[1] == 3 and 10 not in counts and 6 not in counts
    assert ledger.copies(df.limit(0)).count() == 0 and ledger.collapsed(df.limit(0)).count() == 0


def _book(spark, root, rows, batches):
    df = spark.createDataFrame(rows, "id bigint, k string")
    for name, test in batches:
        ledger.Ledger(spark, root, ["k"]).add(df.filter(test), "id", name)
    return {r["k"]: (r["n"], r["first"]) for r in ledger.Ledger(spark, root, ["k"]).rows().collect()}


def test_ledger_in_batches_equals_one_batch_and_reopens(spark, tmp_path, monkeypatch):
    rows = [(i, f"k{i * i % 17}") for i in range(300)]
    want = {k: (sum(x == k for _, x in rows), min(i for i, x in rows if x == k)) for _, k in rows}
    parts = [("c", "id >= 200"), ("a", "id < 100"), ("b", "id BETWEEN 100 AND 199"), ("none", "false")]
    assert _book(spark, f"file://{tmp_path}/one", rows, [("all", "true")]) == want
    assert _book(spark, f"file://{tmp_path}/book", rows, parts) == want
    # batches that come again add nothing
    assert _book(spark, f"file://{tmp_path}/book", rows, parts) == want
    # more keys than buckets take: there are more buckets, and nothing is lost
    monkeypatch.setattr(ledger, "BUCKET_ROWS", 2)
    book = ledger.Ledger(spark, f"file://{tmp_path}/book", ["k"])
    assert book.add(spark.createDataFrame([(500, "new")], "id bigint, k string"), "id", "d") and book.versions[-1][1] > 4
    assert {r["k"]: (r["n"], r["first"]) for r in book.rows().collect()} == want | {"new": (1, 500)}
    # two versions are kept
    assert sum(p.name.startswith("v") for p in (tmp_path / "book").iterdir()) == 2


def test_ledger_survives_a_killed_batch(spark, tmp_path, monkeypatch):
    """A batch that dies after its version is written, but before the manifest, counts once when it comes again."""
    rows = [(i, f"k{i % 5}") for i in range(100)]
    root = f"file://{tmp_path}/book"
    _book(spark, root, rows, [("a", "id < 50")])

    class Killed(Exception):
        pass

    def die(*_):
        raise Killed

    book = ledger.Ledger(spark, root, ["k"])
    df = spark.createDataFrame(rows, "id bigint, k string").filter("id >= 50")
    monkeypatch.setattr(type(spark), "createDataFrame", die)
    with pytest.raises(Killed):
        book.add(df, "id", "b")
    monkeypatch.undo()
    again = ledger.Ledger(spark, root, ["k"])
    assert again.batches == {"a"} and {r["n"] for r in again.rows().collect()} == {10}
    assert _book(spark, root, rows, [("b", "id >= 50"), ("b", "id >= 50")]) == {f"k{i}": (20, i) for i in range(5)}
    assert sum(p.name.startswith("v") for p in (tmp_path / "book").iterdir()) == 2


def test_ledger_is_joined_where_it_lies(spark, tmp_path):
    """The full outer join has one exchange: the batch's aggregation."""
    root = f"file://{tmp_path}/book"
    rows = [(i, f"k{i % 50}") for i in range(500)]
    _book(spark, root, rows, [("a", "id < 250")])
    book = ledger.Ledger(spark, root, ["k"])
    news = spark.createDataFrame(rows, "id bigint, k string").groupBy("k").count()
    plan = book.rows().join(news.hint("merge"), "k", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def _part(sizes, sources, part=0, parts=1, capacity=100):
    """Items of one part as pack hands them over, from whole queues."""
    df = pd.DataFrame({"doc_id": range(len(sizes)), "source": sources, "n": sizes})
    df["before"] = df.groupby("source")["n"].cumsum() - df["n"]
    df["of_source"] = df.groupby("source")["n"].transform("sum")
    df["piece_no"] = [range(-(-n // capacity)) for n in df["n"]]
    df = df.explode("piece_no").astype({"piece_no": int})
    df["before"] += df["piece_no"] * capacity
    df["size"] = (df["n"] - df["piece_no"] * capacity).clip(upper=capacity)
    df["part"] = (df["before"] / df["of_source"] * parts).astype(int)
    return df[df["part"] == part].assign(limit_name="x", parts=parts, total=sum(sizes), max_tokens=capacity).reset_index(drop=True)


def test_packing_holds_its_promises():
    rng = random.Random(2)
    sizes = [int(rng.paretovariate(1) * 20) for _ in range(4000)]
    sources = [rng.choice("aab") for _ in range(4000)]
    out = packing.pack_part(_part(sizes, sources))
    whole = out.groupby("doc_id")["n_tokens"].sum()
    assert whole.sort_index().tolist() == sizes
    assert out.groupby("doc_id").size().sort_index().tolist() == [-(-n // 100) for n in sizes]
    fill = out.groupby("container")["n_tokens"].sum()
    assert fill.max() <= 100 and len(fill) <= 1.02 * -(-sum(sizes) // 100)
    share = sum(n for n, s in zip(sizes, sources) if s == "a") / sum(sizes)
    first = out[out["window_no"] == 0].groupby("source")["n_tokens"].sum()
    assert abs(first["a"] / first.sum() - share) < 0.05


def test_packing_keeps_the_mixture_over_many_parts(spark):
    """Distance of the windows from the target doesn't grow with the number of parts; each item is in one part."""
    rng = random.Random(5)
    rows = [(i, None if i % 41 == 0 else rng.choices("abcde", (40, 25, 20, 10, 5))[0], BYTE, int(rng.lognormvariate(4.5, 1)) + 1) for i in range(30_000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokenizer string, n_tokens bigint").na.fill("", ["source"])
    total = sum(r[3] for r in rows)
    ahead = packing.queued(sized, 30_000 * 40).toPandas()
    for _, queue in ahead.groupby("source"):
        queue = queue.sort_values("before")
        assert (queue["before"].values == queue["n_tokens"].cumsum().values - queue["n_tokens"].values).all() and set(queue["of_source"]) == {queue["n_tokens"].sum()}
    limits = spark.createDataFrame([("p", "pack", BYTE, 256, None)], "limit_name string, purpose string, tokenizer string, max_tokens int, overlap_tokens int")
    for part in (10**6, 500):
        out = packing.pack_sized(sized, limits, part)
        got = packing.mixture(out).first()
        assert got["parts"] == max(1, round(total / 256 / part)) and got["distance"] < 0.05, got
        assert sorted(out.groupBy("doc_id").agg({"n_tokens": "sum"}).toPandas().values.tolist()) == sorted([r[0], r[3]] for r in rows)


def test_packing_frames(spark):
    docs = spark.createDataFrame([(1, "a b c " * 500, "s"), (2, None, None), (3, "", "t"), (4, "x", None)], "doc_id bigint, text string, source string")
    limits = spark.createDataFrame([("p", "pack", BYTE, 100, None), ("q", "split", BYTE, 100, 10)], "limit_name string, purpose string, tokenizer string, max_tokens int, overlap_tokens int")
    rows = packing.pack(docs, limits).collect()
    assert {r["doc_id"] for r in rows} == {1, 4} and max(r["n_tokens"] for r in rows) == 100
    assert packing.pack(docs.limit(0), limits).count() == 0
    pieces = splitting.split(docs, limits).orderBy("piece_no").collect()
    assert {r["doc_id"] for r in pieces} == {1} and splitting.split(docs.limit(0), limits).count() == 0
    assert all(a["first_token"] + a["n_tokens"] - b["first_token"] == 10 for a, b in zip(pieces, pieces[1:]))


def _greedy(level, n, most, shared):
    """The cuts of one text, one after another."""
    cuts, at = [], 0
    while at < n:
        start = at - shared if at else 0
        reach = start + most
        if reach >= n:
            cut = n
        else:
            cut = None
            for kind in (5, 4, 3, 2, 1):
                least = max(start + shared, start + int(most * 0.5)) if kind > 2 else start + shared
                found = [c for c in range(least + 1, reach + 1) if level[c] >= kind]
                if found:
                    cut = found[-1]
                    break
            cut = cut or reach
        cuts.append(cut)
        at = cut
    return cuts


def test_pointer_doubling_equals_greedy_cuts():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 400, 5)
        level = np.concatenate([rng.choice([0, 1, 1, 1, 2, 2, 3, 4, 5], n + 1) for n in sizes])
        first = np.cumsum([0, *(sizes[:-1] + 1)])
        base, stop = np.repeat(first, sizes + 1), np.repeat(first + sizes, sizes + 1)
        most, shared = 40, int(rng.integers(0, 20))
        seen = splitting.reached(splitting.farthest(level, base, stop, most, shared), first)
        for f, n in zip(first, sizes):
            assert (np.flatnonzero(seen[f : f + n + 1])[1:]).tolist() == _greedy(level[f : f + n + 1], n, most, shared)


def test_pieces_of_awkward_texts():
    texts = [None, "", *_texts(), "日本語" * 400, "🙂" * 300, "word " * 700, "x" * 4000, "Line one.\nLine two. " * 200]
    for name, most, shared in ((BYTE, 64, 8), ("word_bpe_49k", 48, 6)):
        by = {}
        for docs, _, *columns in splitting.split_texts(texts, name, [("l", most, shared)]):
            for doc, row in zip(docs.tolist(), zip(*columns)):
                by.setdefault(doc, []).append(row)
        for i, text in enumerate(texts):
            n = tokens.count_tokens(text, name) if text else 0
            assert (i in by) == (n > most)
            if i not in by:
                continue
            rows = by[i]
            assert rows[0][1] == 0 and rows[-1][1] + rows[-1][2] == n and all(r[2] <= most for r in rows)
            assert all(a[1] + a[2] - b[1] == shared for a, b in zip(rows, rows[1:]))
            assert all(text[r[3] : r[3] + r[4]] == r[6] for r in rows)
            assert unicodedata.normalize("NFC", text.strip())[:5] in unicodedata.normalize("NFC", rows[0][6]) or name != BYTE
