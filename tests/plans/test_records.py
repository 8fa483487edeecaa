"""Ids in nested records, commits that break at each step, ids that stay."""

import json

import pytest
from pyspark.errors import PySparkException

from tallymill.operators import commit, enrich, pins
from tallymill.plans.records import NAMES

LINEUPS = [("m", "home", 9, "Ann", "p-ann"), ("m", "home", 7, "Bea", "p-bea"), ("m", "away", 9, "Cem", "p-cem")]
TEAMS = [("m", "home", "t-h", "Homes"), ("m", "away", "t-a", "Aways")]
KIND = "k string, doc struct<home: struct<lists: array<array<struct<name: string, shirt_number: int, deep: struct<player_name: string>>>>, none: struct<name: string>>, shots: array<struct<team_id: string, name: string>>, winner: string, note: map<string, string>>"


def enriched(spark, doc, names=NAMES, schema=KIND):
    df = spark.createDataFrame([("m", doc)], schema)
    lineups = spark.createDataFrame(LINEUPS, "k string, side string, shirt int, name string, id string")
    return enrich.add_ids(df, "k", lineups, names, spark.createDataFrame(TEAMS, "k string, side string, team_id string, team_name string"), {"winner": "winner_id"})


def doc(name="Ann", shirt=9, deep="Bea", team="t-a", shot="Cem", winner="Aways"):
    return ((([[(name, shirt, (deep,))], [], None],), None)[0] + (None,), [(team, shot), None], winner, {"a": "b"})


def test_ids_at_any_depth(spark):
    got = enriched(spark, doc()).first().doc
    inner = got.home.lists[0][0]
    assert (inner.player_id, inner.deep.player_id, inner.name, inner.shirt_number) == ("p-ann", "p-bea", "Ann", 9)
    assert got.home.lists[1] == [] and got.home.lists[2] is None and got.home.none is None
    assert got.shots[0].player_id == "p-cem" and got.shots[1] is None and got.winner_id == "t-a" and got.note == {"a": "b"}
    empty = enriched(spark, doc(name=None, deep=None, shot=None, winner=None)).first().doc
    assert empty.home.lists[0][0].player_id is None and empty.shots[0].player_id is None and empty.winner_id is None


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"shirt": 8}, "shirt_number is in no lineup"), ({"shirt": 7}, "name different players"), ({"name": "Ana"}, "name different players"), ({"shirt": None}, "missing beside a name"), ({"deep": "Cem"}, "is in no lineup"),
        ({"team": "t-x"}, "belongs to neither team"), ({"winner": "Nobody"}, "no team of the match"),
    ],
)
def test_unknown_names_fail(spark, change, message):
    with pytest.raises(PySparkException, match=message):
        enriched(spark, doc(**change)).collect()


def test_two_names_for_one_id_are_refused(spark):
    with pytest.raises(ValueError, match="twice"):
        enriched(spark, (("Ann", "Bea"),), schema="k string, doc struct<home: struct<name: string, player_name: string>>")
    with pytest.raises(ValueError, match="no side"):
        enriched(spark, (("Ann",),), schema="k string, doc struct<other: struct<name: string>>")


class Breaking(commit.Files):
    """Fails at the n-th rename, or dies there so that nothing is undone."""

    def __init__(self, spark, at, dies=False):
        super().__init__(spark)
        self.left, self.dies, self.dead = at, dies, False

    def rename(self, old, new):
        self.left -= 1
        if self.left == 0:
            self.dead = self.dies
            raise KeyboardInterrupt if self.dies else commit.CommitError("broken")
        super().rename(old, new)


def rows(spark, v):
    return spark.createDataFrame([(k, v) for k in range(3)], "id int, v string")


def held(spark, folder, names=("a", "b")):
    files = commit.Files(spark)
    return [{r.v for r in spark.read.parquet(f"{folder}/{n}").collect()} if files.exists(f"{folder}/{n}") else None for n in names]


@pytest.mark.parametrize("dies", [False, True])
@pytest.mark.parametrize("first", [False, True])
def test_commit_leaves_old_or_new_whatever_step_breaks(spark, tmp_path, dies, first):
    for at in range(1, 8):
        folder = f"file://{tmp_path}/{dies}{first}{at}"
        both = lambda v: {f"{folder}/a": rows(spark, v), f"{folder}/b": rows(spark, v)}
        if not first:
            commit.publish(spark, {**both("old"), f"{folder}/gone": rows(spark, "old")}, f"{folder}/journal")
        old = [None, None] if first else [{"old"}, {"old"}]
        stale = () if first else (f"{folder}/gone",)
        try:
            commit.publish(spark, both("new"), f"{folder}/journal", stale=stale, files=Breaking(spark, at, dies))
            broke = False
        except (commit.CommitError, KeyboardInterrupt):
            broke = True
        if dies:
            assert commit.recover(spark, f"{folder}/journal") in ("none", "undone", "completed")
        assert held(spark, folder) == (old if broke else [{"new"}, {"new"}]), at
        assert held(spark, folder, ("gone",)) == ([{"old"}] if broke and not first else [None])
        left = {p.name for p in (tmp_path / f"{dies}{first}{at}").iterdir() if not p.name.startswith(".")} if (tmp_path / f"{dies}{first}{at}").exists() else set()
        assert not any(".old-" in n or n == "journal" for n in left) and (dies or not any(".staged-" in n for n in left))


def test_a_commit_that_dies_after_its_last_rename_is_completed(spark, tmp_path):
    folder = f"file://{tmp_path}/late"

    class Dying(commit.Files):
        def remove(self, path):
            if path.endswith("journal"):
                raise KeyboardInterrupt
            super().remove(path)

    commit.publish(spark, {f"{folder}/a": rows(spark, "old")}, f"{folder}/journal")
    with pytest.raises(KeyboardInterrupt):
        commit.publish(spark, {f"{folder}/a": rows(spark, "new")}, f"{folder}/journal", files=Dying(spark))
    assert commit.recover(spark, f"{folder}/journal") == "completed" and commit.recover(spark, f"{folder}/journal") == "none"
    assert held(spark, folder, ("a",)) == [{"new"}]
    assert [p.name for p in (tmp_path / "late").iterdir() if not p.name.startswith(".")] == ["a"]


def test_counts_and_checks_come_before_any_move(spark, tmp_path):
    folder = f"file://{tmp_path}/gated"
    commit.publish(spark, {f"{folder}/a": rows(spark, "old")}, f"{folder}/journal")
    with pytest.raises(commit.CommitError, match="3 rows instead of 4"):
        commit.publish(spark, {f"{folder}/a": rows(spark, "new")}, f"{folder}/journal", expect={f"{folder}/a": 4})

    def check(path, df):
        raise ValueError("over budget")

    with pytest.raises(ValueError, match="over budget"):
        commit.publish(spark, {f"{folder}/a": rows(spark, "new")}, f"{folder}/journal", check=check)
    assert held(spark, folder, ("a",)) == [{"old"}]
    assert commit.publish(spark, {f"{folder}/j": rows(spark, "x")}, f"{folder}/journal", by={f"{folder}/j": "id"}) == {f"{folder}/j": 3}
    found = sorted((tmp_path / "gated" / "j").glob("id=*/*.json"))
    assert [json.loads(p.read_text()) for p in found] == [{"v": "x"}] * 3


def merged(spark, registry, arrivals):
    r = spark.createDataFrame(registry, "kind string, key int, slug string, id string")
    return sorted(tuple(x) for x in pins.merge_pins(r, spark.createDataFrame(arrivals, "kind string, key int, slug string, nr int").repartition(3), "nr").collect())


def test_pins_stay(spark):
    first = [("player", 5, "ann", 2), ("player", 3, "ann", 1), ("team", 3, "ann", 1), ("player", 3, "ann", 1)]
    once = merged(spark, [], first)
    assert once == [("player", 3, "ann", "ann"), ("player", 5, "ann", "ann-2"), ("team", 3, "ann", "ann")] == merged(spark, [], first[::-1])
    again = merged(spark, once, [("player", 1, "ann", 0), ("player", 5, "ann", 2)])
    assert again == [("player", 1, "ann", "ann-3"), *once] and merged(spark, again, []) == again


@pytest.mark.parametrize(
    ("arrivals", "message"),
    [([("player", 5, "bea", 1)], "another slug"), ([("player", 6, "x", 1), ("player", 6, "y", 1)], "two slugs"), ([("player", 7, "ann", 1), ("player", 8, "ann-2", 1)], "one id")],
)
def test_pins_that_contradict_fail(spark, arrivals, message):
    with pytest.raises(PySparkException, match=message):
        merged(spark, [("player", 5, "ann", "ann")], arrivals)
