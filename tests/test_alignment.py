"""Edges of revised texts: given cases, and chains of runs against all chains."""

import random

from segmill.operators import alignment as ali

SCHEMA = "rec_id string, seg_idx int, original string, revised string"


def aligned(spark, pairs):
    rows = [("r", k, o, r) for k, (o, r) in enumerate(pairs)]
    got = ali.align_revision_boundaries(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return [r.aligned for r in sorted(got, key=lambda r: r.seg_idx)]


def test_invented_and_cut_edges(spark):
    cases = [
        (
            "Ну ты не пугайся, в программах будут такие же названия. Используем команду gid and nead в папке с кодом.",
            "В программах будут такие же названия. Используем команду git init в папке с кодом. Отлично.",
        ),
        (
            "Теперь нужно зафиксировать наши изменения. Делаем это при помощи команды gid Comit.",
            "Теперь нужно зафиксировать наши изменения. Делаем это при помощи команды git commit.",
        ),
        (
            "Нотация JavaScript очень популярна и действительно помогает. Вы можете удалять пустое пространство и относительно просто парсить данные.",
            "Нотация JavaScript очень популярна и действительно помогает. Вы можете удалять пусто",
        ),
        ("two words", " two words more "), ("one two three four", "nothing in common here"), ("", "x"), (None, " y "), ("z", None),
        ("one two three", "well one two three"), ("one two three.", "one two three"), ("- one two three -", "one two three"),
        ("ЁЖ и ёлка тут", "Еж и ЕЛКА тут"),
    ]
    got = aligned(spark, cases)
    assert got[0].startswith("Ну ты не пугайся") and "git init" in got[0] and not got[0].endswith("Отлично.")
    assert got[1].endswith("git commit.")
    assert got[2].endswith("относительно просто парсить данные.")
    assert got[3:] == [
        "two words more", "nothing in common here", "x", "y", None, "one two three", "one two three .", "- one two three -", "Еж и ЕЛКА тут",
    ]


def _runs(a, b):
    """Maximal diagonal runs of at least three equal words."""
    out = []
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] != b[j] or (i and j and a[i - 1] == b[j - 1]):
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= 3:
                out.append((i, j, n))
    return out


def _best(runs):
    """The heaviest chain by trying all of them."""
    best = None

    def walk(weight, first, last):
        nonlocal best
        told = (-weight, *first, *last)
        best = told if best is None else min(best, told)
        for i, j, n in runs:
            rest = n - max(0, last[0] - i, last[1] - j)
            if i + n > last[0] and j + n > last[1] and rest >= 3:
                walk(weight + rest, first, (i + n, j + n))

    for i, j, n in runs:
        walk(n, (i, j), (i + n, j + n))
    return best and best[1:]


def test_chains_equal_all_chains(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(150):
        a = rng.choices("abc", k=rng.randint(0, 16))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            if b:
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 2)] = rng.choices("abcx", k=rng.randint(0, 2))
        rows.append((k, a, b))
        if runs := _runs(a, b):
            want[k] = _best(runs)
    pairs = spark.createDataFrame(rows, "key int, original_words array<string>, revised_words array<string>").repartition(3)
    found = ali.matching_runs(pairs, ["key"])
    by_key = {}
    for r in found.collect():
        by_key.setdefault(r.key, []).append((r.a, r.b, r["size"]))
    assert {k: sorted(v) for k, v in by_key.items()} == {k: sorted(_runs(a, b)) for k, a, b in rows if _runs(a, b)}
    got = {r.key: (r.a, r.b, r.a_end, r.b_end) for r in ali.heaviest_chain(found, ["key"]).collect()}
    assert got == want and len(want) > 60
