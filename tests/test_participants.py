"""Participants of entries with few principals and with many."""

import random

from kinweave.operators.linkage import resolve_participants


def test_entries_of_any_number_of_principals(spark):
    """Against brute force, with up to 40 principals of one name."""
    rng = random.Random(6)
    people = [(i, "67", rng.choice(["georg", "jakob"]), "Haag", 1700 + rng.randrange(2) * 9, None, None) for i in range(60)]
    principals, parts = [], []
    for entry, n in enumerate([0, 1, 13, 14, 15, 16, 17, 20, 25, 40]):
        for given in ("georg", "jakob"):
            of = [p[0] for p in people if p[2] == given]
            for left in (0, 1, 2):
                number = entry * 10 + left + 5 * (given == "jakob")
                kept = set(rng.sample(of, left))
                own = [i for i in of if i not in kept] if n > 20 else rng.sample(of, min(n, len(of)))
                principals += [(number, i) for i in own]
                parts.append((number, "67", given, "Haag", 1705, number))
    got = resolve_participants(
        spark.createDataFrame(parts, "part_id int, key string, given string, surname string, year int, entry int"),
        spark.createDataFrame(people, "person_id int, key string, given string, surname string, year int, birth_y int, death_y int"),
        spark.createDataFrame(principals, "entry int, person_id int"),
    ).collect()
    want = {}
    for number, _, given, *_ in parts:
        fit = [p[0] for p in people if p[2] == given and (number, p[0]) not in set(principals)]
        want[number] = (fit[0] if len(fit) == 1 else None, "none fits" if not fit else "one fits" if len(fit) == 1 else "several fit")
    assert {r.part_id: (r.person_id, r.reason) for r in got} == want and len(got) == len(parts)
    assert {w[1] for w in want.values()} == {"none fits", "one fits", "several fit"}


def test_equal_cells_are_parsed_once(spark):
    from kinweave.operators.ingest import to_entries, to_fields
    from kinweave.operators.mentions import build_mentions

    cells = [(i, "Haag", "Hans" if i % 2 else None, "3 J", "1750-02-03", "Haag, Jacob, weyl." if i % 3 else None) for i in range(12)]
    rows = spark.createDataFrame(cells, "entry long, verstorbener_name string, verstorbener_vorname string, verstorbener_alter string, sterbe_datum string, verstorbener_vater string")
    m = build_mentions(to_entries(to_fields(rows, [(x, [x], None) for x in rows.columns[1:]]), "tod"))
    said = sorted((r.entry, r.path, r.name, r.given, r.name_key, r.given_canon, r.sex, r.age_days, r.birth and r.birth.y, r.deceased) for r in m.collect())
    dead = [(i, "verstorbener", "Haag", "Hans" if i % 2 else None, "04", "johan" if i % 2 else None, "M" if i % 2 else None, 1095, 1747, False) for i in range(12)]
    fathers = [(i, "verstorbener_vater", "Haag", "Jacob", "04", "jakob", "M", None, None, True) for i in range(12) if i % 3]
    assert said == sorted(dead + fathers, key=lambda x: x[:2])
    # Names are parsed below an aggregation of equal cells, which meets the mentions again.
    assert "Join" in m._jdf.queryExecution().optimizedPlan().toString()
