"""Generation with candidates against a loop over prompts, steps and candidates."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.models import generation as G
from quillspark.models import planner as P
from quillspark.operators import rvq
from quillspark.plans import queries

K = 3


def tables():
    rng = random.Random(6)
    rows = [([rng.randrange(4) for _ in range(2 * K)], [rng.randrange(5) for _ in range(K)]) for _ in range(300)]
    library = [(f"t{rng.randrange(60):02}", [rng.randrange(5) for _ in range(K)]) for _ in range(50)]
    prompts = [(i, [rng.randrange(5) for _ in range(K * 2)]) for i in range(12)]  # code 4 follows nothing
    return rows, library, prompts


def by_hand(n_cand, rerank, do_sample, top_p, temp, context, seed, steps):
    rows, library, prompts = tables()
    counts = defaultdict(Counter)
    for ctx, tgt in rows:
        for head in range(K):
            for c in (ctx[-K + head], None):
                counts[head, c][tgt[head]] += 1
    out = []
    for prompt, ctx in prompts:
        for step in range(1, steps + 1):
            dists = []
            for head in range(K):
                c = ctx[-K + head]
                codes = sorted((counts[head, c] or counts[head, None]).items(), key=lambda x: (-x[1], x[0]))
                w = [(code, n ** (1 / temp)) for code, n in codes]
                total, before, kept = sum(x for _, x in w), 0.0, []
                for code, x in w:
                    if before < top_p * total:
                        kept.append((code, x))
                    before += x
                dists.append(kept)
            pred = [d[0][0] for d in dists]
            tried = []
            for cand in range(n_cand if rerank else 1):
                drawn = []
                for head, d in enumerate(dists):
                    u = lambda code: (int(hashlib.md5(f"{seed}|{step}|{prompt}|{cand}|{head}|{code}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48  # noqa: E731, B023
                    drawn.append(min((-math.log(u(code)) / x, code) for code, x in d)[1] if do_sample else d[0][0])
                text, codes = min(((t, c) for t, c in library), key=lambda x: (-sum(a == b for a, b in zip(x[1], drawn, strict=True)), x[0], x[1]))
                tried.append((text, codes, sum(a == b for a, b in zip(codes, pred, strict=True))))
            text, codes, score = max(tried, key=lambda x: x[2])  # the earliest of equals
            out.append((prompt, step, tuple(pred), text, score, f"{score}/{K}", tuple((t, s) for t, _, s in tried)))
            ctx = (ctx + codes)[-K * context :]
    return sorted(out)


@pytest.fixture(scope="module")
def made(spark):
    rows, library, prompts = tables()
    return (spark.createDataFrame(prompts, "prompt_id long, ctx_codes array<int>"), spark.createDataFrame(rows, "ctx_codes array<int>, tgt_codes array<int>"), spark.createDataFrame(library, "text string, codes array<int>"))


@pytest.mark.parametrize("how", [dict(n_cand=5, top_p=0.7, temp=0.5, seed=3), dict(n_cand=3, do_sample=False), dict(rerank=False, top_p=1.0, temp=1.0), dict(n_cand=1, context_sents=2)])
def test_by_hand(made, how):
    out = G.generate(*made, K, 3, save_candidates=True, **how)
    want = {"n_cand": 4, "rerank": True, "do_sample": True, "top_p": 0.9, "temp": 0.8, "context_sents": 6, "seed": 0} | how
    found = sorted((r.prompt_id, r.step, tuple(r.pred_codes), r.text, r.match, r.match_str, tuple(map(tuple, r.candidates))) for r in out.collect())
    assert found == by_hand(want["n_cand"], want["rerank"], want["do_sample"], want["top_p"], want["temp"], want["context_sents"], want["seed"], 3)
    if how.get("n_cand") == 5:
        assert any(len({t for t, _ in r[-1]}) > 1 for r in found) and any(max(s for _, s in r[-1]) > r[-1][0][1] for r in found)


def test_overrides(made):
    with pytest.raises(ValueError, match="beams, width"):
        G.generate(*made, K, 1, width=3, beams=2)
    with pytest.raises(ValueError):
        G.generate(*made, K, 0)
    assert "candidates" not in G.generate(*made, K, 1, n_cand=1).columns
    assert G.Settings().with_overrides(seed=4).seed == 4


def test_draws_follow_weights(spark):
    options = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(w).alias("w")) for c, w in ((7, 6.0), (8, 3.0), (9, 1.0))])
    drawn = Counter(r.c for r in spark.range(20_000).select(G._race(options, 1, F.col("id")).alias("c")).collect())
    assert [round(drawn[c] / 20_000, 2) for c in (7, 8, 9)] == pytest.approx([0.6, 0.3, 0.1], abs=0.02)


def test_plans_do_not_grow(made):
    """Each further step adds the read of one written table, and nothing else."""
    sizes = [str(G.generate(*made, K, n, n_cand=2)._jdf.queryExecution().executedPlan()).count("Scan parquet") for n in (1, 2, 4)]
    assert sizes == [1, 2, 4]


def test_empty_tables(made):
    prompts, rows, library = made
    assert G.generate(prompts, rows, library.limit(0), K, 2).count() == 0
    assert G.generate(prompts.limit(0), rows, library, K, 2).count() == 0


def test_text_to_text(spark):
    """Prompts as texts: the last sentences are embedded and encoded, and the generated ones follow the text."""
    sf = "/root/testdata/sf0.001"
    book = rvq.collect_codebook(queries.codebook(spark, sf))
    texts = [(0, "Only one sentence here. "), (1, " ".join(f"Sentence number {i} of many." for i in range(9)))]
    prompts = spark.createDataFrame(texts, "prompt_id long, text string")
    encoder = P.HashingEncoder(book.shape[2])
    ctx = G.prompt_contexts(prompts, "text", encoder, book)
    for r in ctx.collect():
        last = [r0.s for r0 in prompts.filter(F.col("prompt_id") == r.prompt_id).select(F.explode(T.inference_sentences(F.col("text"))).alias("s")).collect()][-6:]
        last = [last[0]] * (6 - len(last)) + last
        assert list(r.ctx_codes) == rvq.encode_matrix(encoder.encode(last), book).flatten().tolist()
    library = queries._coded(spark, sf).select(F.concat(F.lit("Vector "), F.col("vec_id"), F.lit(".")).alias("text"), "codes")
    steps = G.generate(ctx, queries.planner_rows(spark, sf), library, len(book), 2)
    whole = {r.prompt_id: r.generated for r in G.continued(prompts, "text", steps).collect()}
    for i, text in texts:
        said = [r.text for r in steps.filter(F.col("prompt_id") == i).orderBy("step").collect()]
        assert len(said) == 2 and whole[i] == text.rstrip() + " " + " ".join(said)
    with pytest.raises(ValueError, match="at least one sentence"):
        G.prompt_contexts(spark.createDataFrame([(0, "Hm.")], "prompt_id long, text string"), "text", encoder, book)
