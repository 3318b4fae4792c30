"""Queries of problem 1 over ``qda_code``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.hierarchy import descendant_counts, descendants, resolve_hierarchy
from corpusloom.plans.registry import core
from corpusloom.session import table

_CLOSURE = """
WITH RECURSIVE node AS (
  SELECT id, min(parent_id) AS parent_id FROM qda_code WHERE id IS NOT NULL GROUP BY id
), up AS (
  SELECT n.id, p.id AS anc FROM node n JOIN node p ON p.id = n.parent_id
  UNION
  SELECT u.id, p.id AS anc FROM up u JOIN node n ON n.id = u.anc JOIN node p ON p.id = n.parent_id
), ring AS (SELECT id FROM up WHERE id = anc),
looped AS (
  SELECT u.id, min(u.anc) AS cycle_id FROM up u JOIN ring r ON r.id = u.anc GROUP BY u.id
), depths AS (
  SELECT n.id, count(u.anc) AS depth FROM node n LEFT JOIN up u ON u.id = n.id
  WHERE n.id NOT IN (SELECT id FROM looped) GROUP BY n.id
)"""


@core.query("p1_found", _CLOSURE + " SELECT id, cycle_id FROM looped")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_hierarchy(table(spark, sf_dir, "qda_code"), paths=False)
    return r.where("cycle_id is not null").select("id", "cycle_id")


@core.query(
    "p1_hierarchy",
    _CLOSURE
    + """, tops AS (SELECT id AS top FROM depths WHERE depth = 0),
  rooted AS (SELECT u.id, u.anc AS root_id FROM up u JOIN tops t ON t.top = u.anc UNION ALL SELECT top, top FROM tops),
  steps AS (SELECT d.id, u.anc, a.depth FROM depths d JOIN up u ON u.id = d.id JOIN depths a ON a.id = u.anc
            UNION ALL SELECT id, id, depth FROM depths),
  paths AS (SELECT id, string_agg(CAST(anc AS VARCHAR), '/' ORDER BY depth) AS path FROM steps GROUP BY id),
  below AS (SELECT u.anc AS id, count(*) AS n FROM up u JOIN depths d ON d.id = u.id GROUP BY u.anc)
SELECT n.id, r.root_id, CAST(d.depth AS INT) AS depth, p.path, coalesce(b.n, 0) AS n_descendants, l.cycle_id
FROM node n LEFT JOIN depths d ON d.id = n.id LEFT JOIN rooted r ON r.id = n.id AND d.id IS NOT NULL
LEFT JOIN paths p ON p.id = n.id LEFT JOIN below b ON b.id = n.id LEFT JOIN looped l ON l.id = n.id""",
)
def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendant_counts(resolve_hierarchy(table(spark, sf_dir, "qda_code")))


@core.query(
    "p1_descendants",
    _CLOSURE
    + """ SELECT u.anc AS ancestor_id, u.id, CAST(d.depth - a.depth AS INT) AS distance
FROM up u JOIN depths d ON d.id = u.id JOIN depths a ON a.id = u.anc""",
)
def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(resolve_hierarchy(table(spark, sf_dir, "qda_code")))
