import numpy as np
import pytest

from hirameki.llm import embeddings


def brute(ids, vectors, least=0.9):
    """n_links and component of each row, for usable vectors of distinct ids."""
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    for _ in range(len(ids)):
        new = np.minimum(label, np.where(hit, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            break
        label = new
    return hit, hit.sum(axis=1), label


def vectors(n_groups, size, rnd, spread, copies=True):
    out = []
    for _ in range(n_groups):
        center = rnd.normal(size=size)
        for _ in range(rnd.integers(1, 9)):
            out.append(center + rnd.normal(size=size) * spread)
            if copies and rnd.random() < 0.2:
                out.append(out[-1] * rnd.choice([1.0, 3.0]))
    return np.array(out, np.float32)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    x = vectors(150, 64, rnd, 0.12)
    ids = rnd.permutation(len(x)).tolist()
    _, n, label = brute(ids, x)
    odd = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (9004, [None] + [1.0] * 63), (9005, []), (9006, [1.0] * 3), (None, x[0].tolist()), (9007, [float("inf")] * 64)]
    df = spark.createDataFrame([*((i, v.tolist(), "k") for i, v in zip(ids, x, strict=True)), *((i, v, "k") for i, v in odd)], "vec_id long, embedding array<float>, kept string")
    got = embeddings.near_vectors(df.repartition(4)).collect()
    assert len(got) == len(x) + len(odd)
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert [by_id[i] for i in ids] == [(a, b, b == i) for i, a, b in zip(ids, n.tolist(), label.tolist(), strict=True)]
    assert all(by_id[i] == (0, i, True) for i, _ in odd)


def test_recall_near_the_threshold(spark):
    rnd = np.random.default_rng(3)
    x = vectors(400, 64, rnd, 0.33, copies=False)
    hit, n, _ = brute(range(len(x)), x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df, width=9).collect()}
    found = sum(got.values())
    assert all(got[i] <= n[i] for i in got) and 300 < hit.sum() and found >= 0.95 * hit.sum()


@pytest.mark.parametrize("block", [50, 4096])
def test_large_bucket_is_dealt_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=16) + rnd.normal(size=(300, 16)) * 0.02, rnd.normal(size=(20, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, n, label = brute(range(len(x)), x)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {i: (n[i], label[i]) for i in range(len(x))}


def test_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_common_offset(spark):
    """Vectors that all lie in one direction: bits stay balanced, so few pairs meet, and recall holds."""
    rnd = np.random.default_rng(5)
    x = vectors(4500, 64, rnd, 0.25, copies=False)[:20_000].astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    offset = rnd.normal(size=64)
    x = (x + offset / np.linalg.norm(offset) * np.sqrt(0.7 / 0.3)).astype(np.float32)
    y = embeddings.normal(x)
    assert 0.65 < (y[:2000] @ y[-2000:].T).mean() < 0.75
    hit = y @ y.T >= 0.9
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df).collect()}
    n = hit.sum(axis=1)
    assert all(got[i] <= n[i] for i in got) and sum(got.values()) >= 0.95 * n.sum() > 0
    coder = embeddings.planned(y, len(y), 0.9, 0.98, None)
    bits = coder.bits(y)
    assert (np.abs(bits.mean(axis=0) - 0.5) < 0.12).all()
    sizes = [np.unique(coder.keys(bits, t), return_counts=True)[1] for t in range(len(coder.tables))]
    code = embeddings.packed(bits)
    some = rnd.integers(0, len(y), (200_000, 2))
    apart = np.bitwise_count(code[some[:, 0]] ^ code[some[:, 1]]).sum(axis=1)
    met = sum(float((s.astype(float) ** 2).sum()) for s in sizes) / len(y) ** 2  # pairs of codes, by table
    assert met * (apart <= coder.apart).mean() < 0.05 and met < 0.5


def test_group_that_holds_a_third(spark):
    rnd = np.random.default_rng(8)
    x = np.concatenate([rnd.normal(size=64) + rnd.normal(size=(1500, 64)) * 0.2, vectors(700, 64, rnd, 0.2, copies=False)[:3000]]).astype(np.float32)
    _, n, _ = brute(range(len(x)), x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df).collect()}
    assert all(got[i] <= n[i] for i in got) and sum(got[i] for i in range(1500)) >= 0.98 * n[:1500].sum() and sum(got.values()) >= 0.98 * n.sum()


def test_lengths_are_compared_apart(spark):
    rnd = np.random.default_rng(6)
    rows, want = [], {}
    for size, n in ((64, 60), (16, 12), (3, 4)):
        x = vectors(n, size, rnd, 0.1, copies=False)
        ids = [len(rows) + i for i in range(len(x))]
        _, links, label = brute(ids, x)
        want |= {i: (a, b) for i, a, b in zip(ids, links.tolist(), label.tolist(), strict=True)}
        rows += [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.999).collect()}
    assert got == want


def test_tables_bring_the_recall_asked_for():
    x = embeddings.normal(np.random.default_rng(7).normal(size=(3000, 64)))
    coder = embeddings.planned(x, 100_000, 0.9, 0.98, None)
    for a, b in embeddings.pairs_at(x[::-1], 0.9):
        assert embeddings.recall_of(coder.bits(a) != coder.bits(b), coder.tables)[-1] > 0.96
    bits = coder.bits(x)
    first = embeddings.first_met(coder, embeddings.packed(bits[:500]), embeddings.packed(bits[500:1000]), 5)
    slow = [i for i in range(500) if all((bits[i, t] != bits[500 + i, t]).any() for t in coder.tables[:5])]
    assert first.tolist() == slow
