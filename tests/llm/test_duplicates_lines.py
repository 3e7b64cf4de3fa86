import random
import re
from collections import Counter

from pagemill.llm import near_duplicates, site_lines
from pagemill.llm.components import connected_components


def bag(question, options):
    return Counter(re.findall(r"[^\W_]+", " ".join([question or "", *(o or "" for o in options or [])]).lower()))


def pairs_by_hand(rows, threshold=0.88):
    bags = {i: bag(q, o) for i, q, o in rows if i is not None}
    ids, out = sorted(bags), set()
    for a in ids:
        for b in ids:
            if a < b and (n := sum(bags[a].values()) + sum(bags[b].values())) and 2 * sum((bags[a] & bags[b]).values()) / n >= threshold:
                out.add((a, b))
    return out


def made_up(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "é", "Ñandú", "2024"]
    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(4, 60))]
        for _ in range(rng.randint(1, 4)):
            near = base[:]
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rng.shuffle(near)
            cut = rng.randint(1, len(near))
            rows.append((len(rows), " ".join(near[:cut]).upper() + "?", [" ".join(near[cut:]), None]))
    return rows + [(1000, None, None), (1001, "", []), (1002, "...", [" "]), (1003, "same words", None), (1004, "words same", [None])]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "question_id long, question string, options array<string>, rep string")


def test_pairs_as_brute_force(spark):
    rows = made_up()
    got = {tuple(r) for r in near_duplicates.near_pairs(table(spark, rows)).collect()}
    assert got == pairs_by_hand(rows) and (1003, 1004) in got
    assert near_duplicates.near_pairs(table(spark, rows).limit(0)).count() == 0


def test_groups_are_components_of_the_pairs(spark):
    rows = made_up(2)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs_by_hand(rows):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    # texts without a word have one bag, so they are one class, but similar to none
    got = {r["question_id"]: r["group_id"] for r in near_duplicates.near_groups(table(spark, rows)).collect()}
    blank = {1000, 1001, 1002}
    assert {k: v for k, v in got.items() if k not in blank} == {r[0]: root(r[0]) for r in rows if r[0] not in blank}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 3)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(31)} | {(i, 100) for i in range(100, 140)} | {(200, 200), (201, 200), (202, 200)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def lines_by_hand(rows):
    files = {}
    for page, file, text in rows:
        if text and text.strip():
            files.setdefault(file, []).append((page, [" ".join(x.split()).lower() for x in text.split("\n")]))
    out = set()
    for pages in files.values():
        on = Counter(x for _, lines in pages for x in set(lines) if x)
        if len(pages) >= 10:
            out |= {(p, i) for p, lines in pages for i, x in enumerate(lines) if x and on[x] >= 0.25 * len(pages)}
    return out


def test_repeated_lines_as_by_hand(spark):
    rng = random.Random(3)
    notices = ["Share  this", "© Press", "BY line\t9", "İstanbul", "sums"]
    rows = []
    for file, n in ((0, 40), (1, 10), (2, 9), (None, 12)):
        for _ in range(n):
            lines = [f"own line {rng.randint(0, 500)}" for _ in range(4)] + [rng.choice([x, x.upper(), f" {x} "]) for x in notices if rng.random() < 0.3] + [""]
            rng.shuffle(lines)
            rows.append((len(rows), file, "\n".join(lines)))
    rows += [(900, 0, None), (901, 0, " \n "), (902, 0, "share this\nshare this")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, file_index int, text string, line_no int")
    found = site_lines.repeated_lines(df)
    assert {tuple(r) for r in found.collect()} == lines_by_hand(rows)
    clean = {r["page_id"]: r["text"] for r in site_lines.without_lines(df, found).collect()}
    gone = lines_by_hand(rows)
    assert clean == {p: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (p, i) not in gone) for p, _, t in rows}
    assert {r["page_id"]: r["text"] for r in site_lines.clean_pages(df).collect()} == clean
    assert site_lines.repeated_lines(df.limit(0)).count() == site_lines.clean_pages(df.limit(0)).count() == 0
