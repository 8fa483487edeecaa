"""Ids beside every name, at any depth of a nested record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.operators.matching import must

SIDES = ("home", "away")


def add_ids(records: DataFrame, on: str, lineups: DataFrame, names: dict[str, tuple[str, str]], teams: DataFrame | None = None, team_names: dict[str, str] | None = None) -> DataFrame:
    """``records`` with an id field beside each name field of its structs and arrays.

    ``names`` says for a name's field its id's field and the field of its shirt
    number; ``lineups(on, side, shirt, name, id)`` holds who played. The side is the nearest
    field ``home`` or ``away`` on the way to the name, else the one whose team the struct's
    ``team_id`` names (``teams(on, side, team_id, team_name)``). Where the struct has a shirt, the shirt
    decides and the name must agree; a shirt that is null beside a name fails. Where
    it has none, the name alone decides. ``team_names`` says the same for fields that hold a team's name.

    Rewriting follows the schema and only adds fields; records keep their order and
    their nulls. One join brings each record its lineup as maps (a match's players); a
    name, shirt or team that is in none fails the query with its path.
    """
    sided = lambda side, c: F.concat_ws("\x00", side, c.cast("string"))
    maps = lambda rows, *pairs: rows.groupBy(on).agg(*(F.map_from_entries(F.collect_set(F.struct(k, v))).alias(n) for n, k, v in pairs))
    met = records.join(maps(lineups, ("by_shirt_", sided(F.col("side"), F.col("shirt")), F.col("id")), ("by_name_", sided(F.col("side"), F.col("name")), F.col("id"))), on, "left")
    if teams is not None:
        met = met.join(maps(teams, ("side_of_", F.col("team_id").cast("string"), F.col("side")), ("team_of_", F.col("team_name"), F.col("team_id"))), on, "left")
    team_names = team_names or {}

    def resolved(struct: Column, fields: set[str], name: str, shirt: str, side: str | None, path: str) -> Column:
        said = struct[name]
        at = F.lit(side) if side else F.col("side_of_")[struct["team_id"].cast("string")] if "team_id" in fields and teams is not None else None
        if at is None:
            raise ValueError(f"{path}.{name} lies under no side and its struct has no team")
        by_name = F.col("by_name_")[sided(at, said)]
        if shirt in fields:
            # both looked up once: a lambda's body is evaluated for each mention
            once = F.array(F.struct(F.col("by_shirt_")[sided(at, struct[shirt])].alias("shirt"), by_name.alias("name")))
            agreed = lambda m: must(m["shirt"].isNotNull(), must(m["name"].eqNullSafe(m["shirt"]), m["shirt"], f"{path}.{name} and its shirt name different players"), f"{path}.{shirt} is in no lineup")
            found = must(struct[shirt].isNotNull(), F.get(F.transform(once, agreed), F.lit(0)), f"{path}.{shirt} is missing beside a name")
        else:
            found = F.get(F.transform(F.array(by_name), lambda m: must(m.isNotNull(), m, f"{path}.{name} is in no lineup")), F.lit(0))
        return F.when(said.isNotNull(), must(at.isNotNull(), found, f"{path} belongs to neither team"))

    def rewritten(value: Column, kind: T.DataType, side: str | None, path: str) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: rewritten(x, kind.elementType, side, f"{path}[]")) if _nested(kind.elementType) else value
        if not isinstance(kind, T.StructType):
            return value
        held = set(kind.names)
        own = [rewritten(value[f.name], f.dataType, f.name if f.name in SIDES else side, f"{path}.{f.name}").alias(f.name) for f in kind]
        written: dict[str, str] = {}
        for name, (target, shirt) in names.items():
            if name in held and isinstance(kind[name].dataType, T.StringType):
                if target in written or target in held:
                    raise ValueError(f"{path} would write {target} twice")
                written[target] = name
                own.append(resolved(value, held, name, shirt, side, path).alias(target))
        for name, target in team_names.items():
            if name in held:
                if target in written or target in held:
                    raise ValueError(f"{path} would write {target} twice")
                written[target] = name
                team = F.col("team_of_")[value[name]]
                own.append(F.when(value[name].isNotNull(), must(team.isNotNull(), team, f"{path}.{name} is no team of the match")).alias(target))
        return F.when(value.isNotNull(), F.struct(*own))

    return met.select(*(rewritten(F.col(f.name), f.dataType, f.name if f.name in SIDES else None, f.name).alias(f.name) if _nested(f.dataType) else F.col(f.name) for f in records.schema))


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) or isinstance(kind, T.ArrayType) and _nested(kind.elementType)
