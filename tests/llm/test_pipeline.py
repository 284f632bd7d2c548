"""Every stage of the pipeline against brute force over what the stage before kept."""

import collections
import itertools
import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
from strandline.llm import toxicity  # noqa: E402

from .test_llm import removed, shingle_set, unite  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("ara", "elo", "ioni") for c in "nst"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90))) for _ in range(120)]
    texts += [texts[0], texts[1] + " \n", texts[2] + " one", None, ""]
    long = [rng.choice(vocabulary) for _ in range(80)]  # ten of 76 shingles of five words change: similarity 0.79 and 0.87
    texts += [" ".join(long), " ".join([*long[:75], "else", *long[76:]]), " ".join([*long[:30], "else", *long[31:60], "other", *long[61:]])]
    texts += [" ".join([*texts[3].split()[:20], "zolgut", "vrexil"]), *(f"{' '.join(rng.choice(vocabulary) for _ in range(9))} zolgut" for _ in range(40))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, int("zolgut" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    tokenizer = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
        out = stage(spark, docs, str(tmp_path))
        if k == 4:
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == {i for i, _ in before}
            held, by_doc = collections.defaultdict(list), collections.defaultdict(list)
            for r in pieces:
                held[r.sequence_id].append((r.offset, r.length))
                by_doc[r.doc_id].append((r.piece, r.start, r.length))
            for placed in held.values():  # gapless from 0, within the limit
                ends = [0, *itertools.accumulate(n for _, n in sorted(placed))]
                assert [at for at, _ in sorted(placed)] == ends[:-1] and ends[-1] <= 2048
            for i, text in before:
                n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
                assert sorted(by_doc[i]) == [(p, 2048 * p, min(2048, n - 2048 * p)) for p in range(-(-n // 2048))]
            break
        assert out.columns == names, name
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after)
        if k == 0:
            scored = toxicity.score_toxicity(spark.createDataFrame(before, "doc_id long, text string"), toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")))
            assert set(after) == {r.doc_id for r in scored.collect() if not r.predicted}
        elif k == 1:
            groups = collections.defaultdict(list)
            for i, t in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
            assert set(after) == {min(g)[1] for g in groups.values()}
        elif k == 2:
            sets = [shingle_set(t, 5) for _, t in before]
            root = unite(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
            least = {}
            for (i, _), r in zip(before, root, strict=True):
                least[r] = min(least.get(r, 1 << 60), i)
            assert set(after) == set(least.values())
        else:
            want = removed([t for _, t in before], 200)
            assert {i: len((after[i] or "").encode()) for i, _ in before} == {i: n - gone for (i, _), (n, gone, _, _) in zip(before, want, strict=True)}


def test_empty_table_through_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
