import random
import re

from test_operators import SCHEMA

from keyloom.llm import line_dedup


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c\nd e", "en", "s", 9, None), (1, "a b c\nf g", "en", "s", 9, None), (2, "d e\n \nh", "en", "s", 7, None), (None, "a b c", "en", "s", 5, None), (3, None, None, None, None, None), (4, "", "en", "s", 0, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.l_removed for r in got) == 2 and min(r.l_removed for r in got) == 0
    one = sorted(r.text for r in got if r.doc_id == 1)
    assert one in (["a b c\nd e", "f g"], ["a b c\nf g", "d e"])
    assert {r.doc_id: (r.text, r.l_lines, r.l_removed, r.n_chars) for r in got if r.doc_id != 1} == {2: (" \nh", 2, 1, 3), None: ("a b c", 1, 0, 5), 3: (None, 0, 0, None), 4: ("", 0, 0, 0)}


def test_ties_and_groups_of_near_copies(spark):
    """Every line of a group is a near copy of a line that itself goes; chains count link by link to earlier lines."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows, lines, want = [], [], {}
    for d in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(60)] = f"x{d}{rng.random()}"
        rows.append((d, " ".join(own) + "\n" + f"alone {d} \t tab\x0bfeed  two" + "\n\n" + " ".join(base[:5])))
    for d, text in rows:
        gone = 0
        for line in text.split("\n"):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            if words:
                own = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
                gone += any(100 * len(own & o) >= 75 * len(own | o) for o in lines)
                lines.append(own)
        want[d] = gone
    got = {r.doc_id: r.n_removed for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and 40 < sum(want.values()) < 120


def test_an_empty_table_and_clashing_names(spark):
    assert line_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a\na", "x", 5, 6)], "doc_id long, text string, l_pos string, nth int, L_removed int")
    out = line_dedup.clean_documents(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a", "x", 5, 6)]


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """Short lines with one passage in common, each with a near copy of its own."""
    monkeypatch.setattr(line_dedup, "COUNTS", 1, raising=False)  # a count table as full as a large input makes it, if there is one
    lines = [f"one passage that all have {d} x{d}" for d in range(300)]
    rows = [*enumerate(lines), *((300 + d, line + " more") for d, line in enumerate(lines))]
    made, write = [], line_dedup.store.materialize

    def counted(df, name):
        out = write(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup.store, "materialize", counted)
    got = {r.doc_id: r.n_removed for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: int(d >= 300) for d in range(600)}
    assert sum(n for name, n in made if name in ("headed", "pairs")) <= 1800


def test_lines_within_longer_ones_are_not_examined(spark, monkeypatch):
    """Each short line is part of a line six times as long, so none can be similar; one near copy stays found."""
    rows = []
    for d in range(100):
        short = " ".join(f"s{d}x{k}" for k in range(12))
        rows += [(2 * d, short), (2 * d + 1, short + "".join(f" l{d}x{k}" for k in range(60)))]
    rows.append((200, rows[7][1] + " more"))
    made, write = {}, line_dedup.store.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup.store, "materialize", counted)
    got = {r.doc_id: r.n_removed for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: int(d == 200) for d in range(201)}
    assert made["promising"] <= 3
