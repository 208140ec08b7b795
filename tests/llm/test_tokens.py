import random

from hypothesis import given, settings
from hypothesis import strategies as st

from twintable.llm.tokens import chunk_ends, encode_corpus, load, segments, token_counts

BPE = load()
PIECE, SPLIT = BPE.ready()


def whole(text):
    import tiktoken

    return tiktoken.__dict__["_kept_encodings"][BPE.name][0].encode_ordinary(text)


def by_chunks(text, ends):
    ids, at = [], 0
    coded = lambda *span: [i for m in SPLIT.finditer(text, *span) for i in PIECE(m[0])]
    for k, a, b, c in segments(text, ends, SPLIT):
        assert a == at and a <= b <= c
        first = ends[k - 1] if k else 0
        own = coded(first, ends[k])
        ids += own[len(coded(first, a)) : len(own) - len(coded(b, ends[k]))] if a < b else []
        ids += [i for m in SPLIT.finditer(text, b) if m.start() < c for i in PIECE(m[0])]
        at = c
    assert at == len(text)
    return ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 'srelvdmt\n\t1.!é日 ", min_size=2, max_size=40), st.data())
def test_any_cut_is_mended(text, data):
    ends = sorted(data.draw(st.sets(st.integers(1, len(text) - 1), max_size=8)) | {len(text)})
    assert by_chunks(text, ends) == whole(text)


def test_every_cut_in_contractions_is_mended():
    for text in ["we'll be", "we've been", "they're a", "'ll", "'re're", "!'ll", " 've", "we'lx", "we''ve", "a'r'll ve", "we'll've", "l'l", "日'll"]:
        inner = range(1, len(text))
        for cuts in [*([i] for i in inner), *([i, j] for i in inner for j in inner if i < j), list(inner)]:
            assert by_chunks(text, [*cuts, len(text)]) == whole(text), (text, cuts)


def test_contractions_cut_in_the_corpus(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["we'll", "they've", "you're", "been", "going", f"at{rnd.randrange(500)}", "soon"]) for _ in range(400)) for _ in range(60)]
    inside = sum(t[e - 2 : e + 1] in ("'ll", "'ve", "'re") for t, ends in zip(texts, chunk_ends(texts)) for e in ends)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert inside and {r.id: list(r.ids) for r in encode_corpus(df, "doc_id", "text", BPE).collect()} == {i: whole(t) for i, t in enumerate(texts)}


def test_generated_english_with_contractions(spark):
    rnd = random.Random(17)
    words = ["we'll", "they've", "you're", "it's", "don't", "I'm", "she'd", "who'll've", "the", "very", "desk", "there", "shelf", "rover", "well", "I'd've", "'re", "l'", "'l"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(20, 120))) for _ in range(1000)]
    texts.append("well very desk the that I bought a in good the for very it and we'll keep it there, they've said so and you're fine with it the that lamp good well in")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.id: list(r.ids) for r in encode_corpus(df, "doc_id", "text", BPE).collect()} == {i: whole(t) for i, t in enumerate(texts)}


def test_chunks_cover_and_are_shared():
    rnd = random.Random(1)
    common = "".join(rnd.choice("abcdefgh ijk") for _ in range(3000))
    texts = [common, "prefix " + common, "", "x"]
    ends = chunk_ends(texts)
    for t, e in zip(texts, ends):
        assert (e[-1] if e else 0) == len(t) and e == sorted(set(e))
    parts = [{t[a:b] for a, b in zip([0, *e], e)} for t, e in zip(texts, ends)]
    assert len(parts[0] & parts[1]) > 0.7 * len(parts[0])


def test_corpus(spark):
    rnd = random.Random(2)
    long = " ".join(rnd.choice(["word", "don't", "123", "日本語", "\n\n", "é"]) for _ in range(20_000))
    texts = [None, "", " ", "   ", "<|endoftext|>", "a" * 9000, " " * 500 + "x", long, long[5:], "x́\U0001f600" * 50, "\r\n\r\n"]
    texts += ["the very same text, again and again, long enough for more than one chunk of it to be cut somewhere"] * 300
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, pos int")
    got = {r.id: list(r.ids) for r in encode_corpus(df, "doc_id", "text", BPE).collect()}
    assert got == {i: whole(t or "") for i, t in enumerate(texts)}
    assert {r.id: r.n for r in token_counts(df, "doc_id", "text", BPE).collect()} == {i: len(whole(t or "")) for i, t in enumerate(texts)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode_corpus(df, "doc_id", "text", BPE).count() == 0


def test_repeated_rows_give_a_row_each(spark):
    text = "some words that are long enough to be cut into more than one chunk, in the usual manner, " * 3
    df = spark.createDataFrame([("a", text), ("a", text), ("a", "other"), (None, "x")], "k string, t string")
    rows = [(r.id, list(r.ids)) for r in encode_corpus(df, "k", "t", BPE).collect()]
    assert sorted(rows, key=str) == sorted([("a", whole(text)), ("a", whole(text)), ("a", whole("other")), (None, whole("x"))], key=str)
