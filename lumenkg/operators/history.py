"""Histories of repositories, and the table of users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored, tidy

KEY = ["repo", "id"]


def _jumped(nodes: DataFrame, steps: int) -> DataFrame:
    """repo, id, at, dist, end: where at least ``steps`` steps (repo, id, next; end where the way ends) lead, by doubling. end is null where the way goes on."""
    way = nodes.select(*KEY, F.when(F.col("end").isNull(), F.col("next")).otherwise(F.col("id")).alias("at"), F.when(F.col("end").isNull(), 1).otherwise(0).alias("dist"), "end")
    way = stored(way, "ways")
    for _ in range(steps.bit_length()):
        # Ways that have ended stay out of the join: all of a repository end in one commit.
        on = way.select("repo", F.col("id").alias("at"), F.col("at").alias("then"), F.col("dist").alias("more"), F.col("end").alias("last"))
        moved = way.where("end is null").join(on, ["repo", "at"], "left")
        moved = moved.select(*KEY, F.coalesce("then", "at").alias("at"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("last").alias("end"))
        way = stored(way.where("end is not null").unionByName(moved), "ways")
    return way


def _folded(edges: DataFrame, most: int) -> DataFrame:
    """repo, id, found, visits of merges of which enough is known. Parents are walked from the last to the first, each to its end, until one finds the head."""
    none = F.struct(F.lit(False).alias("over"), F.lit(False).alias("stuck"), F.lit(False).alias("found"), F.lit(1).alias("visits"))

    def walk(acc, x):
        sum_ = acc["visits"] + F.coalesce(x["visits"], F.lit(0))
        met = F.struct((x["found"] | (sum_ > most)).alias("over"), F.lit(False).alias("stuck"), (x["found"] & (sum_ <= most)).alias("found"), F.least(sum_, F.lit(most + 1)).alias("visits"))
        stuck = F.struct(F.lit(True).alias("over"), F.lit(True).alias("stuck"), F.lit(False).alias("found"), acc["visits"].alias("visits"))
        return F.when(acc["over"], acc).when(x["visits"].isNull(), stuck).otherwise(met)

    own = edges.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("nth", "found", "visits")), asc=False).alias("all"))
    return own.select(*KEY, F.aggregate("all", none, walk).alias("r")).where("not r.stuck").select(*KEY, "r.found", "r.visits")


@tidy
def new_commits(branches: DataFrame, parents: DataFrame, most: int = 500) -> DataFrame:
    """repo, name, tip of branches other than the head whose tip is not the head's and whose walk meets the head.

    A walk takes the last parent first, goes back to others where a way ends, visits a commit again where it meets
    it again, and gives up after ``most`` visits; parents of a visited commit are seen.
    branches: repo, name, tip, is_head (one head a repository; repositories without one have no new commits).
    parents: repo, id, parent and, where their order is known, nth (else they are in order of their names); a first
    commit has a null parent. Parents without a row of their own are missing: seen, but not visited. Repeated rows
    count once, rows with a null repository or commit are left out.

    No walk is done for a branch. As the last parent comes first, the first ``most`` commits visited are those along
    last parents, found for all commits by doubling in log2(most) joins. Only where that way ends sooner, at a first
    commit, do other parents count: these few are folded from the first commits up, merge after merge, and a merge
    that is not known after ``most`` rounds has a walk that gives up.
    """
    nth = F.col("nth") if "nth" in parents.columns else F.col("parent")
    rows = stored(parents.where("repo is not null and id is not null").select(*KEY, "parent", nth.alias("nth")).distinct(), "parents")
    heads = branches.where("is_head and tip is not null").select("repo", F.col("tip").alias("head")).distinct()
    ids = rows.select(*KEY).distinct()
    direct = rows.join(heads.withColumnRenamed("head", "parent"), ["repo", "parent"], "left_semi").select(*KEY).distinct().withColumn("direct", F.lit(True))
    links = stored(rows.join(ids.withColumnRenamed("id", "parent"), ["repo", "parent"], "left_semi").select(*KEY, "parent", "nth"), "links")
    last = links.groupBy(*KEY).agg(F.max_by("parent", F.struct("nth", "parent")).alias("next"), F.count("*").alias("n"))
    nodes = stored(ids.join(last, KEY, "left").join(direct, KEY, "left"), "nodes")
    way = _jumped(nodes.withColumn("end", F.when(F.col("direct"), "head").when(F.col("next").isNull(), "first")), most)
    known = way.where("end is null or end = 'head'").select(*KEY, (F.col("end").isNotNull() & (F.col("dist") < most)).alias("found"), F.when(F.col("end").isNotNull() & (F.col("dist") < most), F.col("dist") + 1).otherwise(most + 1).alias("visits"))
    # Near first commits: to the next merge or first commit.
    near = nodes.join(way.where("end = 'first'").select(*KEY), KEY, "left_semi")
    near = _jumped(near.withColumn("end", F.when(F.col("next").isNull(), "first").when(F.col("n") > 1, "merge")), most)
    merges = near.where("end = 'merge' and dist = 0").select(*KEY)
    one = known.select("repo", F.col("id").alias("parent"), "found", "visits")
    two = near.select("repo", F.col("id").alias("parent"), "at", "dist", "end")
    edges = links.join(merges, KEY, "left_semi").join(one, ["repo", "parent"], "left").join(two, ["repo", "parent"], "left")
    ended = F.col("end") == "first"
    edges = stored(edges.select(*KEY, "nth", "at", "dist", F.coalesce("found", F.when(ended, F.lit(False))).alias("found"), F.coalesce("visits", F.when(ended, F.col("dist") + 1)).alias("visits")), "merges")
    folded = None
    for _ in range(most):
        if edges.isEmpty():
            break
        done = stored(_folded(edges, most), "folded")
        if done.isEmpty():
            break
        folded = done if folded is None else folded.unionByName(done)
        met = done.select("repo", F.col("id").alias("at"), F.col("found").alias("f"), F.col("visits").alias("v"))
        edges = edges.join(done, KEY, "left_anti").join(met, ["repo", "at"], "left")
        edges = stored(edges.select(*KEY, "nth", "at", "dist", F.coalesce("found", "f").alias("found"), F.coalesce("visits", F.col("v") + F.col("dist")).alias("visits")), "merges")
    found = known.where("found").select(*KEY)
    if folded is not None:
        hit = folded.where("found").select("repo", F.col("id").alias("at"), "visits")
        found = found.unionByName(near.where("end = 'merge'").join(hit, ["repo", "at"]).where(F.col("dist") + F.col("visits") <= most).select(*KEY))
    others = branches.where("not is_head").join(heads, "repo", "left_semi").join(heads.withColumnRenamed("head", "tip"), ["repo", "tip"], "left_anti")
    return others.join(found.withColumnRenamed("id", "tip"), ["repo", "tip"], "left_semi").select("repo", "name", "tip")


def archive_states(projects: DataFrame, archives: DataFrame, queued: DataFrame) -> DataFrame:
    """projects (id) with state: queued before live (there is such an archive) before none."""
    live = archives.select("id").distinct().withColumn("live", F.lit(True))
    waits = queued.select("id").distinct().withColumn("queue", F.lit(True))
    out = projects.join(live, "id", "left").join(waits, "id", "left")
    return out.select("id", F.when(F.col("queue"), "queued").when(F.col("live"), "live").otherwise("none").alias("state"))


def upserted(users: DataFrame, rows: DataFrame, key: str = "gitlab_id", keep: tuple[str, ...] = ("id", "is_admin")) -> DataFrame:
    """users with rows put in or, where the key is known, put over; the columns of keep stay as they were."""
    old = users.select(key, *[F.col(c).alias(f"_{c}") for c in users.columns if c != key], F.lit(True).alias("_old"))
    met = rows.select(*users.columns).withColumn("_new", F.lit(True)).join(old, key, "full_outer")
    pick = lambda c: F.coalesce(f"_{c}", c) if c in keep else F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_{c}"))
    return met.select(*[F.col(key) if c == key else pick(c).alias(c) for c in users.columns])


def with_admin(users: DataFrame, user: int, admin: bool) -> DataFrame:
    return users.withColumn("is_admin", F.when(F.col("id") == user, F.lit(admin)).otherwise(F.col("is_admin")))
