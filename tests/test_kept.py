"""Counts brought up to date equal counts from scratch."""

import random

from test_core import pts
from test_saved import book, save

from chronotopia.operators import encounters
from chronotopia.operators.deltas import between_count, changed_count
from chronotopia.plans import kept, saved
from chronotopia.sources import store


def test_ten_random_changes(spark):
    rng = random.Random(4)
    some = lambda *x: rng.choice([None, *x])

    def row(name):
        y = rng.randint(1795, 1806)
        z = y + rng.choice([0, 0, 0, 3, 15, -2, -9])
        return (name, some(y, y, y), some(z, z, z), some(1, 2), some(1, 2), some("x", "y"), some("r"), some("c", "d"), some("n"))

    books = {n: [row(n) for _ in range(rng.randint(0, 25))] for n in "abcdef"}
    table = lambda names: pts(spark, *[r for n in names for r in books[n]], *([] if any(books[n] for n in names) else [row("zz")])).filter("book_id <> 'zz'")
    grains = [("year", "city"), ("day", "none"), ("month", "country"), ("none", "neighborhood"), ("century", "region")]
    for step in range(10):
        grain = grains[step % len(grains)]
        n = encounters.pair_count(table(books), *grain).first()["n"]
        out = rng.sample(sorted(books), rng.randint(0, 2))
        gone, rest = table(out), table([b for b in books if b not in out])
        for b in out:
            del books[b]
        coming = [f"n{step}{k}" for k in range(rng.randint(0, 2))]
        stay = list(books)
        books.update({b: [row(b) for _ in range(rng.randint(0, 25))] for b in coming})
        got = changed_count(n, gone, table(coming), rest, *grain)
        assert got == encounters.pair_count(table(books), *grain).first()["n"], (step, grain, out, coming, stay)


def test_only_places_of_the_change_are_counted(spark):
    y = (1800, 1800, None, None)
    a, b = pts(spark, ("a", *y, "x", None, "c", None)), pts(spark, ("b", *y, "x", None, "c", None), ("b", *y, None, None, "c", None), ("b", *y, "y", None, "c", None), ("b", *y, "x", None, "d", None))
    assert between_count(a, b, "year", "city").first()["n"] == 2
    plan = between_count(a, b, "year", "city")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_replaced_book_in_the_store(spark, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "kept")
    grains = [("year", "city"), ("none", "country")]
    save(spark, root, "r1", book(spark, "a", "London"), book(spark, "b", "London"), book(spark, "c", "Paris"))
    kept.refresh(spark, root, path, grains)
    got = lambda: {(r.time, r.location): r.n for r in kept.counts(spark, path).collect()}
    assert got() == {grains[0]: 1, grains[1]: 3} and [r.country for r in kept.countries(spark, path).collect()] == ["x"]
    kept.refresh(spark, root, path, grains)
    assert len(store.names(spark, path)) == 1  # nothing has changed
    save(spark, root, "r2", book(spark, "b", "Paris"), book(spark, "d", "Paris"), replace_books=True)
    store.remove_books(spark, root, "a")
    kept.refresh(spark, root, path, grains)
    points = saved.match_points(spark, root)
    assert got() == {g: encounters.pair_count(points, *g).first()["n"] for g in grains} == {g: 3 for g in grains}
    store.remove_books(spark, root, "b")
    store.remove_books(spark, root, "d")
    kept.refresh(spark, root, path, [("day", "region")])
    assert got() == {grains[0]: 0, grains[1]: 0, ("day", "region"): 0} and kept.countries(spark, path).collect() == []
