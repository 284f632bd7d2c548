"""Cross-tokenizer alignment against both libraries on whole texts, link by link."""

import collections
import hashlib
import random

import pytest
from strandline.llm import cross_tokenizer
from strandline.llm.bpe_codec import byte_alphabet

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
PATHS = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def tokens(libraries, text):
    """[(id, bytes)] of either side for the whole text at once."""
    a, b = libraries
    back = byte_alphabet()
    e = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(back[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    return left, right


def brute(libraries, rows):
    """The contract's rows, from every pair of tokens of every group."""
    docs, holds = [], collections.Counter()
    for i, text in rows:
        left, right = tokens(libraries, text) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
            docs.append((i, 0, 0, 0, [], ""))
            continue
        groups, links, x, y, pa, pb = [], [], 0, 0, 0, 0
        while x < len(left):
            ga, gb, x, y = [left[x][0]], [right[y][0]], x + 1, y + 1
            pa, pb = pa + len(left[x - 1][1]), pb + len(right[y - 1][1])
            while pa != pb:
                if pa < pb:
                    ga.append(left[x][0])
                    pa, x = pa + len(left[x][1]), x + 1
                else:
                    gb.append(right[y][0])
                    pb, y = pb + len(right[y][1]), y + 1
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
            links += [(p, q) for p in ga for q in gb]
        docs.append((i, len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        holds.update(set(links))
    most = collections.Counter()
    for (p, _), n in holds.items():
        most[p] = max(most[p], n)
    return collections.Counter(
        (i, na, nb, ng, len(links), sum(holds[x] == most[x[0]] for x in links), sum(holds[x] for x in links), sha) for i, na, nb, ng, links, sha in docs
    )


TEXTS = [
    None, "", " ", "  ", "\n", "a", "a", "hello world", "hello  world ", " hello\n\n world\t x", "don't we'll  it's", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b c",
    "é é ﬁ 你好 世界。 こんにちは あ い", "  x  y　 z", "\x00 \x1c \x85 q", "🙂🙃 🙂", "1234567 89,01.5 %%%%", "x" * 3000, "ab " * 4000, "    indented\n        more",
    "русский текст и ещё", "naïve café — “quotes”…", " lead", "trail ", "a\r\n b\v\f c",
]


def collected(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_alignment_equals_every_pair(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(7, "hello world"), (None, "hello world")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, block long, codes string")
    assert collected(cross_tokenizer.alignment_digests(df, *PATHS)) == brute(libraries, rows)


def test_alignment_of_random_texts_in_small_blocks(spark, libraries, monkeypatch):
    r = random.Random(5)
    alphabet = ["the", " ", "  ", "\n", "tion", "é", "你", "Zq", "0", ".", "'s", " ", "　", "Ж", "-", "🙂", "x́"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(1, 120)))) for i in range(400)]
    monkeypatch.setattr(cross_tokenizer, "CHUNK_BYTES", 50)
    store = cross_tokenizer.Units(cross_tokenizer.tokenizers_of(*PATHS))
    import pyarrow as pa

    block = cross_tokenizer._Block(pa.chunked_array([[t for _, t in rows]]), store)
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(libraries, rows)
    assert collected(cross_tokenizer.alignment_digests(df, *PATHS)) == want
    assert [block.digest(k) for k in range(len(rows))] == [x[-1] for x in sorted(want)]
    groups = {x["doc_id"]: x["groups"] for x in cross_tokenizer.token_groups(df, *PATHS).collect()}
    assert [hashlib.sha256(groups[i].encode()).hexdigest() if groups[i] else "" for i, _ in rows] == [x[-1] for x in sorted(want)]


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = cross_tokenizer.alignment_digests(df, *PATHS)
    assert out.count() == 0 and "count_sum" in out.columns
