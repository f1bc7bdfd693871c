"""Exit policies bar by bar, first passages by scan, dominance by all pairs."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import evolve, genomes


def walked(position, price, atr, take, stop, hold):
    """One bar after another; a closed position stays flat while the signal is at that side."""
    out, i = list(position), 0
    while i < len(out):
        if out[i] == 0:
            i += 1
            continue
        side, unit = (1.0 if out[i] > 0 else -1.0), atr[i] if atr[i] > 0 else 0.001 * price[i]
        gain, loss = price[i] + side * take * unit, price[i] - side * stop * unit
        for j in range(i + 1, len(out)):
            if out[j] != side:
                i += 1
                break
            if side * (price[j] - gain) >= 0 or side * (price[j] - loss) <= 0 or j - i >= hold:
                out[j] = 0.0
                k = j + 1
                while k < len(out) and abs(out[k] - side) < 0.01:
                    out[k] = 0.0
                    k += 1
                i = j + 1
                break
        else:
            return out
    return out


def test_exits_equal_a_walk():
    rnd = random.Random(1)
    for trial in range(400):
        n = rnd.randint(1, 70)
        levels = ([0.0, 1.0, -1.0], [0.0, 1.0, 1.0, -1.0, 0.5, -0.3, 0.995, 1.0], [1.0])[trial % 3]
        position = np.array([rnd.choice(levels) for _ in range(n)])
        position = np.repeat(position, 1 + trial % 4)[:n]
        price = np.round(100 * np.exp(np.cumsum([rnd.gauss(0, 0.01) for _ in range(n)])), 2)
        atr = np.array([rnd.choice((0.0, math.nan, 0.5, 1.0, 2.0)) for _ in range(n)])
        take, stop, hold = rnd.choice((0.5, 1.0, 2.5)), rnd.choice((0.5, 1.0, 2.0)), rnd.choice((1, 2, 5, 50))
        got = genomes.exited(position, price, atr, take, stop, hold, genomes.Passage(price))
        assert got.tolist() == walked(position, price, atr, take, stop, hold)


def test_first_passage():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 33, 100):
        price = rnd.integers(0, 12, n).astype(float)
        passage, after, level = genomes.Passage(price), np.arange(n), rnd.integers(0, 14, n).astype(float)
        for above in (True, False):
            want = [next((j for j in range(i + 1, n) if (price[j] >= level[i] if above else price[j] <= level[i])), n) for i in range(n)]
            assert passage.first(after, level, above).tolist() == want


def test_fitness_over_folds_and_regimes(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(s, i, rnd.choice(genomes.REGIMES[:2]) if i % 50 else "RANGING", 100 + 10 * math.sin(i / 9) + rnd.random(), rnd.choice((0.5, 1.0)), rnd.choice((0.01, 0.04)), rnd.random()) for s in "ab" for i in range(420)]
    names = ["symbol", "ts", "regime", "price", "atr", "vol", "p"]
    df = spark.createDataFrame(rows, "symbol string, ts int, regime string, price double, atr double, vol double, p double").repartition(5)
    genes = [(k, genomes.REGIMES[k % 3], 1.0 + k / 7, 0.5 + k / 9, 4 + k, genomes.SIZINGS[k % 3]) for k in range(12)]
    monkeypatch.setattr(genomes, "CHUNK", 3)
    got = {r.id: r for r in genomes.fitness(spark.createDataFrame(genes, "id long, regime string, take double, stop double, hold int, sizing string"), df).collect()}
    assert len(got) == 12
    data = pd.DataFrame(rows, columns=names)
    for k, regime, take, stop, hold, sizing in genes:
        found = []
        for _, x in data.groupby("symbol"):
            x, c = x.sort_values("ts").reset_index(drop=True), len(x) // 6
            for fold in range(1, 6):
                y = x.iloc[fold * c : (fold + 1) * c if fold < 5 else None]
                y = y[y.regime == regime]
                if len(y) >= 20:
                    pos = genomes.sized(sizing, y.p.to_numpy(), y.vol.to_numpy())
                    pos = pd.Series(walked(pos, y.price.to_numpy(), y.atr.to_numpy(), take, stop, hold), index=y.index)
                    held = pos.shift(fill_value=0.0)
                    pnl = held * y.price.pct_change().fillna(0) - 0.001 * (pos - held).abs()
                    eq = (1 + pnl).cumprod()
                    found.append((round(pnl.mean() / pnl.std() * math.sqrt(8760), 4) if pnl.std() > 0 else 0.0, -round((1 - eq / eq.cummax()).max(), 6), (pos - held).abs().mean(), eq.iloc[-1] - 1))
        r = got[k]
        assert r.folds == len(found)
        if not found:
            assert r.sharpe is None and r.calmar is None
            continue
        f = np.array(found)
        assert r.sharpe == pytest.approx(f[:, 0].mean(), abs=1e-3) and r.max_drawdown == pytest.approx(f[:, 1].mean(), abs=1e-6) and -r.thrift == pytest.approx(f[:, 2].mean())
        assert r.win_rate == (f[:, 0] > 0).mean() and r.calmar == pytest.approx(f[:, 3].mean() / abs(f[:, 1].mean()), rel=1e-4)


def test_children_keep_to_ranges_and_regimes(spark):
    first = genomes.seeded(spark, 60)
    children = genomes.bred(first, first.where("id < 40"), 80, sigma=2.0).collect()
    regime = {r.id: r.regime for r in first.collect()}
    assert len(children) == 80 and len({c.id for c in children}) == 80
    for c in children:
        assert genomes.TAKE[0] <= c["take"] <= genomes.TAKE[1] and genomes.STOP[0] <= c.stop <= genomes.STOP[1] and genomes.HOLD[0] <= c.hold <= genomes.HOLD[1]
        assert {regime[p] for p in c.parents} == {c.regime} and c.generation == 1


@pytest.mark.parametrize("block", [4096, 16])
def test_fronts_by_rounds_equal_all_pairs(spark, monkeypatch, block):
    rnd = random.Random(5)
    rows = [(i, *[float(rnd.randint(0, 9)) if rnd.random() > 0.02 else None for _ in range(5)]) for i in range(300)]
    points = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in evolve.OBJECTIVES)).repartition(4)
    monkeypatch.setattr(evolve, "BLOCK", block)
    assert {(r.id, r.front) for r in evolve.dominance_fronts(points, small=60).collect()} == {(r.id, r.front) for r in evolve.dominance_fronts(points).collect()}
    value = {r[0]: [-math.inf if x is None else x for x in r[1:]] for r in rows}
    beats = lambda a, b: -math.inf not in a and all(x >= y for x, y in zip(a, b, strict=True)) and a != b
    first = {i for i in value if not any(beats(value[j], value[i]) for j in value)}
    assert {r.id for r in evolve.dominance_fronts(points, small=60).where("front = 1").select("id").collect()} == first
    assert evolve.dominance_fronts(points.limit(0)).count() == 0


def test_fronts_take_as_many_jobs_as_a_way_through_the_grid(spark, monkeypatch):
    """A chain has as many fronts as points: jobs don't grow with fronts; every front against all pairs on ties, copies and missing values."""
    monkeypatch.setattr(evolve, "BLOCK", 40)
    jobs, written = [], evolve.written
    monkeypatch.setattr(evolve, "written", lambda df: jobs.append(1) or written(df))
    schema = "id long, " + ", ".join(f"{c} double" for c in evolve.OBJECTIVES)
    chain = spark.createDataFrame([(i, *[float(i)] * 5) for i in range(200)], schema)
    assert {(r.id, r.front) for r in evolve.dominance_fronts(chain, small=50).collect()} == {(i, 200 - i) for i in range(200)}
    assert len(jobs) <= 12
    rnd = random.Random(8)
    rows = [(i, *[rnd.choice([math.inf, math.nan, None]) if rnd.random() < 0.02 else float(rnd.randint(0, 5)) for _ in range(5)]) for i in range(400)]
    rows += [(400 + i, *rows[i % 7][1:]) for i in range(60)]
    got = {r.id: r.front for r in evolve.dominance_fronts(spark.createDataFrame(rows, schema), small=50).collect()}
    value = {r[0]: [x if x is not None and math.isfinite(x) else -math.inf for x in r[1:]] for r in rows}
    want = {}
    for i in sorted(value, key=value.get, reverse=True):
        want[i] = 1 + max((want[j] for j in want if -math.inf not in value[j] and value[j] != value[i] and all(a >= b for a, b in zip(value[j], value[i], strict=True))), default=0)
    assert got == want
