import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepane.llm import tokens as T


@pytest.fixture(scope="module")
def vocab():
    return T.vocabulary()


@pytest.fixture(scope="module")
def documents_text(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


ALPHABET = st.sampled_from(["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'", "'re", "1", "23", "-", "--", "é", "日本", "🙂", " ", "\x1c", "​"])
TEXT = st.lists(ALPHABET, max_size=120).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from([1, 7, 16, 50, 400]), st.sampled_from([1, 9]))
def test_streaming_gives_the_ids_of_the_whole(text, block, times):
    vocab = T.vocabulary()
    text = text * times
    assert list(T.encode_text(text, vocab, block)) == vocab.whole(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "123", "--", "'s", "'", "é", "日本", "🙂", "\x1c", "\u200b"]), min_size=1, max_size=200), st.integers(1, 9), st.integers(1, 300))
def test_texts_without_white_space(parts, times, block):
    vocab = T.vocabulary()
    text = "".join(parts) * times
    assert list(T.encode_text(text, vocab, block)) == vocab.whole(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abehirst", min_size=1, max_size=600), st.integers(1, 90), st.sampled_from(["", " ", "\n \n", "."]))
def test_long_pieces_in_windows(text, block, glue):
    vocab = T.vocabulary()
    text = glue.join([text] * 3)
    assert list(T.encode_text(text, vocab, block)) == vocab.whole(text)


@pytest.mark.parametrize("unit", ["thequickbrownfox", " ", "\n", "1", "日本語", "-=", "a'sb"])
def test_memory_stays_bounded(vocab, unit):
    encoder = T.StreamEncoder(vocab)
    held, out = 0, []
    for _ in range(200):
        out += encoder.feed(unit * 64)
        held = max(held, len(encoder.tail) + len(encoder.text))
    out += encoder.finish()
    assert held <= 4 * vocab.lookahead + 64 * len(unit.encode()) and out == vocab.whole(unit * 64 * 200)


def test_every_text_is_streamed(vocab, monkeypatch, documents_text):
    """All characters of all texts are fed, and what the library gets at once is bounded by the block, not by the text."""
    fed, most = [], []
    feed, cut, piece = T.StreamEncoder.feed, T.StreamEncoder._cut, vocab.piece
    monkeypatch.setattr(T.StreamEncoder, "feed", lambda self, chunk, last=False: fed.append(len(chunk)) or feed(self, chunk, last))
    monkeypatch.setattr(T.StreamEncoder, "_cut", lambda self, at: most.append(at) or cut(self, at))
    monkeypatch.setattr(vocab, "piece", lambda data: most.append(len(data)) or piece(data))
    texts = [*documents_text, None, "", "x" * 50_000, "word " * 20_000]
    ids = [list(T.encode_text(t, vocab)) for t in texts]
    assert sum(fed) == sum(len(t or "") for t in texts) and max(fed) <= T.BLOCK
    assert max(most) <= T.BLOCK + 2 * vocab.lookahead
    fed.clear()
    assert [T.count_tokens(t, vocab) for t in texts] == [len(i) for i in ids] and sum(fed) == sum(len(t or "") for t in texts)


def test_lookahead_of_small_merge_lists():
    assert T.sufficient_lookahead([]) == 1
    # "ab" depends on whether "bc" (lower rank) takes its b, so it needs one byte more than the longest token.
    assert T.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 1 + 2
    assert T.sufficient_lookahead([(b"a", b"b"), (b"b", b"c")]) == 0 + 2
    chain = [(b"d", b"e"), (b"c", b"d"), (b"b", b"c"), (b"a", b"b")]
    assert T.sufficient_lookahead(chain) == 3 + 2


def test_lookahead_suffices_on_random_merge_lists():
    r = random.Random(3)
    for _ in range(60):
        tokens, rules = {b"a", b"b", b"c"}, []
        for _ in range(r.randint(1, 8)):
            x, y = r.choice(sorted(tokens)), r.choice(sorted(tokens))
            if x + y not in tokens:
                tokens.add(x + y)
                rules.append((x, y))
        look = T.sufficient_lookahead(rules)

        def merged(data, rules=rules):
            parts = [data[i : i + 1] for i in range(len(data))]
            for x, y in rules:
                i, out = 0, []
                while i < len(parts):
                    if parts[i : i + 2] == [x, y]:
                        out.append(x + y)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            return parts

        def bounds(parts, upto):
            out, at = [], 0
            for p in parts:
                at += len(p)
                if at <= upto:
                    out.append(at)
            return out

        for _ in range(40):
            text = bytes(r.choice(b"abc") for _ in range(r.randint(1, 30)))
            cut = r.randint(1, len(text))
            # Where the prefix ends a token with enough bytes behind it, the whole text ends the same token there.
            assert bounds(merged(text[:cut]), cut - look) == bounds(merged(text), cut - look)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_decoding_restores_the_text(text, step):
    vocab = T.vocabulary()
    ids = vocab.whole(text)
    decoder = T.StreamDecoder(vocab)
    out = "".join(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + decoder.finish()
    assert out == text == T.decode_ids(ids, vocab)


def test_broken_bytes_become_replacement_characters(vocab):
    half = [vocab.ranks[b"\xe6"]] if b"\xe6" in vocab.ranks else []
    assert T.decode_ids(half, vocab) == "�"


def test_tables(spark, vocab):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> hi", "x"), (3, "<|endoftext|> hi", "x"), (None, "a" * 200_000, "x"), (5, "\r\n \t", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in T.token_ids(df).collect()), key=repr)
    assert got == sorted(((k, vocab.whole(t or "")) for k, t, _ in rows), key=repr)
    assert T.token_ids(df).schema["ids"].dataType.simpleString() == "array<int>"
    back = sorted(((r["doc_id"], r["text"]) for r in T.decoded_texts(T.token_ids(df)).collect()), key=repr)
    assert back == sorted(((k, t or "") for k, t, _ in rows), key=repr)
    sizes = T.token_counts(df.drop("ids")).collect()
    assert sorted(r["n_tokens"] for r in sizes) == sorted(len(vocab.whole(t or "")) for _, t, _ in rows)
    assert T.token_ids(df.limit(0)).count() == 0
