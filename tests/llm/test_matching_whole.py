import random

import numpy as np
from kiosko.llm import matching

V = "struct<name string, address string, city string>"


def registry(spark):
    return spark.createDataFrame([(s, "Madrid", "ES", "Europe/Madrid", "es") for s in ("s2", "s3")], "id string, city string, country string, timezone string, locale string")


def met(spark, rows):
    """The pairs of ordinals that are compared."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ordinal long, source_id string, title string, start_raw string, venue {V}")
    p = matching.profiles(df, registry(spark)).cache()
    of = {r.profile: r.ordinal for r in p.collect()}
    return {tuple(sorted((of[r.a], of[r.b]))) for r in matching.candidates(p).collect()}


def test_words_of_a_show_listed_often_stay_telling(spark):
    rows = [("s2", "Vorelgam Kasumor", f"2026-03-01 20:{k:02d}", None) for k in range(20)] + [("s3", "Kasumor Vorelgam", "2026-03-01 20:00", None)]
    assert met(spark, rows) == {(k, 20) for k in range(20)}


def test_titles_of_common_words_meet_without_a_place(spark):
    rows = [("s2", "Jazzavond", f"2026-03-{k + 1:02d} 20:00", None) for k in range(20)]
    rows += [("s3", "Jazzavond", "2026-03-01 20:00", None), ("s3", "Jazzavond", "2026-03-02 20:00", ("Zaal Rood", None, "Madrid")), ("s3", "Jazzavond (vol)", "2026-03-03 20:00", None)]
    rows += [("s3", "Lezing (vol)", f"2026-04-{k + 1:02d} 20:00", None) for k in range(20)]
    assert met(spark, rows) == {(0, 20), (1, 21), (2, 22)}


def test_names_meet_when_each_has_an_error_and_no_place_helps(spark):
    rows = [("s2", "Jazz met Tutoril Laelohu", "2026-03-01 20:00", ("Filmhuis Melmuzes", None, "Madrid")), ("s3", "Avond: Tutoirl Larlohu", "2026-03-01 20:00", None)]
    rows += [("s2", "Kennismakingsborrel @ Filmhuis Melmuzes", "2026-03-02 20:00", ("Filmhuis Melmuzes", None, "Madrid")), ("s3", "Kenismakingsborrel", "2026-03-02 20:00", None), ("s3", "Pintolle", "2026-03-02 20:00", None)]
    rows += [("s2", f"{k} met Naam{x} Deel{x}", f"2026-05-{ord(x) - 87} 20:00", None) for x in "abcdef" for k in ("Jazz", "Avond")]  # kinds of evening are common
    assert met(spark, rows) == {(0, 1), (2, 3)}


def test_a_hot_group_of_copies_is_compared_once(spark):
    rows = [(s, "Vorelgam Kasumor", "2026-03-01 20:00", ("Zaal Rood", None, "Madrid")) for s, n in (("s2", 200), ("s3", 3)) for _ in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ordinal long, source_id string, title string, start_raw string, venue {V}")
    p = matching.profiles(df, registry(spark)).cache()
    assert matching.candidates(p).count() == 1
    assert matching.matched(df, registry(spark)).count() == 600
    got = {(r["class"], r.n_links): 0 for r in matching.classes(df, registry(spark)).collect()}
    assert set(got) == {(0, 1), (200, 1)}


def grid(points):
    x = np.array([[np.nan if v is None else v for v in p] for p, _ in points], float)
    return matching.Mixture(x, np.array([n for _, n in points], float))


def test_the_mixture_tells_another_time_of_the_day_and_spreads_its_confidence():
    points = [((1, 1, 1), 900), ((0.9, 1, 0.95), 100), ((1, 1, 0.8), 40), ((1, None, None), 30), ((1, 1, 0.1), 90), ((1, 0, 1), 30), ((1, 0, 0.1), 60), ((0.1, 1, 0.9), 20)]
    g = 1 / (1 + np.exp(-grid(points).fit()))
    assert (g[[0, 1, 2, 3]] > 0.5).all() and (g[[4, 5, 6, 7]] < 0.5).all()
    assert g[0] > g[2] and g[0] > g[3]


def test_projection_onto_transitivity():
    o = np.array([[-1.0, 4.0, 4.0], [-6.0, 1.0, 3.0], [5.0, 1.0, 1.0]])
    g = 1 / (1 + np.exp(-o))
    third, one, two = matching._project(o[:, 0], o[:, 1], o[:, 2], matching._Arrays)
    assert (one * two <= third + 1e-9).all()
    assert third[0] > g[0, 0] and third[1] == g[1, 0] and one[1] < g[1, 1] and two[1] == g[1, 2] and third[2] == g[2, 0]


def test_two_runs_agree_and_extra_columns_do_not_matter(spark):
    rows = [(i, s, f"Show {chr(97 + i // 2)}elgam Kas{chr(97 + i // 2)}umor", f"2026-03-{1 + i // 2:02d} 20:00", ("Zaal Rood", None, "Madrid"), "x") for i, s in enumerate(["s2", "s3"] * 10)]
    df = spark.createDataFrame(rows, f"ordinal long, source_id string, title string, start_raw string, venue {V}, profile string")
    a, b = (sorted(map(tuple, matching.matched(df, registry(spark)).collect())) for _ in range(2))
    assert a == b and [x[:2] for x in a] == [(2 * k, 2 * k + 1) for k in range(10)]


def test_names_without_a_place_match_on_a_day_full_of_one_kind_of_event(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    houses, shows = [f"Zaal {name()}" for _ in range(200)], [f"{name()} {name()}" for _ in range(20)]
    rows = [(s, "Speelmiddag", f"2026-03-01 {9 + k % 12:02d}:{5 * (k % 11):02d}", (h, None, "Madrid")) for s in ("s2", "s3") for k, h in enumerate(houses)]
    rows += [(s, t, "2026-03-01 20:00", None) for s in ("s2", "s3") for t in shows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ordinal long, source_id string, title string, start_raw string, venue {V}")
    got = {(r.ordinal_a, r.ordinal_b) for r in matching.matched(df, registry(spark)).collect()}
    assert got == {(k, 200 + k) for k in range(200)} | {(400 + k, 420 + k) for k in range(20)}
