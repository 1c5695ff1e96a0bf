"""Token counts against the library that the model is made for."""

import random

import pytest

from graphweft.llm import tokens

pieces = pytest.importorskip("sentencepiece")
vocabularies = pytest.importorskip("public_tokenizers")
MODEL = vocabularies.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, rank string"


def counted(texts):
    return [len(x) for x in pieces.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)]


def hard_texts():
    rnd = random.Random(1)
    parts = ["a", "e", " ", "  ", "▁", "the", "in", "\n", "é", "ß", "\t", "0", "1", "/", "=", "日", "Ж", "x", "'", '"', "<", ">", "ing", "\U0001f600", "=-=", "<s>", "<0x0A>", "<unk>", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += [f for n in range(70) for f in (" " * n, " " * n + "the", "x" + " " * n + "é", " " * n + "日", " " * n + "\n" + " " * n, "a" * n, "=" * n)]
    return texts + ["", "ab" * 3000, "日本語テキスト" * 300, "".join(rnd.choice("abcXYZ019+/") for _ in range(20000)), " " * 100_000 + "x" + " " * 50_001]


def test_counts_of_hard_texts():
    texts = hard_texts()
    assert tokens.Counter(tokens.read_model(MODEL)).count(texts).tolist() == counted(texts)


@pytest.mark.parametrize("window", [1, 7, 50])
def test_windows_change_nothing(monkeypatch, window):
    monkeypatch.setattr(tokens, "WINDOW", window)
    texts = hard_texts()[:400] + [" " * 60 + "the" + " " * 33]
    assert tokens.Counter(tokens.read_model(MODEL)).count(texts).tolist() == counted(texts)


def test_equal_hashes_are_told_apart():
    counter = tokens.Counter(tokens.read_model(MODEL))
    counter.mix[:] = 1  # every sequence of a length has the same hash
    texts = hard_texts()[:300]
    assert counter.count(texts).tolist() == counted(texts)


def test_a_small_vocabulary_merges_in_order():
    """Scores that make a merge possible that comes before the one that made its part, and equal scores from the left."""

    def slow(text, scores):
        symbols = list(text)
        while True:
            found = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in scores]
            if not found:
                return len(symbols)
            i = min(found)[1]
            symbols[i : i + 2] = ["".join(symbols[i : i + 2])]

    rnd = random.Random(3)
    for _ in range(40):
        scores = {c: 0.0 for c in "abc"} | {"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 6))): float(rnd.randrange(-6, 0)) for _ in range(12)}
        counter = tokens.Counter(tokens.Merges(scores, True))
        counter._points = lambda text: tokens.np.frombuffer(text.encode("utf-32-le"), tokens.np.int32)
        texts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 30))) for _ in range(30)]
        got = [int(counter._sequences(*_sequences(counter, t)).sum()) for t in texts]
        assert got == [slow(t, scores) for t in texts]


def _sequences(counter, text):
    points = tokens.np.frombuffer(text.encode("utf-32-le"), tokens.np.int32)
    symbols, cut = counter._cut(points, tokens.np.array([0]))
    return symbols, points, tokens.np.flatnonzero(cut)


def test_rows(spark):
    rows = [(1, None, "c", "c"), (None, "", "c", "c"), (2, "Ünï text", "c", "c"), (2, "Ünï text", "c", "c"), (3, "x y " * 4000, "c", "c"), (4, "ab" * 200_000, "c", "c")]
    got = sorted(map(tuple, tokens.token_counts(spark.createDataFrame(rows, SCHEMA), MODEL).collect()), key=repr)
    want = [(i, len((t or "").encode()), counted([t or ""])[0], counted([t or ""])[0] > 4096) for i, t, *_ in rows]
    assert got == sorted(want, key=repr)
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), MODEL).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in rows], counted([r[1] or "" for r in rows]), strict=True))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, MODEL).collect()} == want


def test_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Exchange" not in tokens.token_counts(docs, MODEL)._jdf.queryExecution().executedPlan().toString()


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="only BPE models"):
        tokens.read_model(str(tmp_path / "m"))
