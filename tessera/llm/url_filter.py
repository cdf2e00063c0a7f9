"""URL filter: path-template trees per host, and fixed rules.

Every host's paths form a tree of segments.  Going down level by level, a
segment becomes part of a template:

* variable segments (numbers, hashes) become the wildcard of their shape;
* remaining branches of one node whose share of bad labels does not differ
  from that of their siblings (two-proportion test against all others of the
  node) merge into one wildcard, however many they are and however few pages
  each has; a branch that differs stays by itself, whatever its siblings are.

A template is rejected when its smoothed share of bad labels,
``(bad + strength * prior) / (labelled + strength)`` with the corpus share as
prior, reaches the threshold.  Fixed rules come first: a rule fits its host
and all subdomains, if the path starts with the rule's; the longest wins.

All of it is joins and partially aggregated counts over distinct (host, path)
rows: a hot host spreads over its nodes and paths, and no node's branches are
gathered.  A path that is alone in its branch has nothing to be compared with
and is finished at once, so there are as many rounds as the deepest level at
which two paths still share a node; no level is cut off.

Cases: a null url, or one without ``://``, has an empty host and path; a null
page id has no label; contradicting labels of a page count as bad; without
any label nothing is rejected by templates; repeated rows are judged alike
(each counts as a page); an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, staged

Z_SIMILAR = 2.58           # branches whose shares differ by less merge
PRIOR_STRENGTH = 8.0
MAX_BAD = 0.6
#: Rule lists (short strings) are broadcast up to this many host rows.
BROADCAST_HOSTS = 200_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def shape(segment: Column) -> Column:
    """Wildcard of a segment that looks like an identifier, else null.  A file
    name keeps its ending."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    ending = F.substring(segment, F.length(stem) + 1, F.lit(16))
    kind = (F.when(stem.rlike(r"^[0-9]+$"), "{n}")
            .when(stem.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), "{date}")
            .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{hex}")
            .when(F.length(F.regexp_replace(stem, r"[^0-9]", "")) * 2 > F.length(stem), "{id}"))
    return F.concat(kind, ending)


def templates(paths: DataFrame, z_similar: float = Z_SIMILAR) -> DataFrame:
    """(host, path, template) of the rows (host, path, n, labelled, bad)."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    tail = F.when(F.col("path").endswith("/"), "/").otherwise("")
    at = staged(paths.withColumn("_s", parts).withColumn("_tail", tail).withColumn("node", F.lit("")), "url-paths")
    keep, level, done = ["host", "path", "n", "labelled", "bad"], 0, []
    while True:
        done.append(at.where(F.size("_s") <= level).select(*keep, F.concat("node", "_tail").alias("template")))
        at = at.where(F.size("_s") > level)
        if at.isEmpty():
            break
        segment = F.get("_s", F.lit(level))
        here = at.withColumn("_g", segment).withColumn("_b", F.coalesce(shape(segment), segment))
        branch = (here.where("_b IS NOT NULL").groupBy("host", "node", "_b")
                  .agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"),
                       F.max(F.col("_b") != F.col("_g")).alias("wild"), F.count(F.lit(1)).alias("paths")))
        branch = staged(branch, "url-branches")
        plain = F.when(~F.col("wild"), 1)
        node = branch.groupBy(F.col("host").alias("_h"), F.col("node").alias("_n")).agg(
            F.count(plain).alias("k"),
            F.sum(F.when(~F.col("wild"), F.col("l"))).alias("al"), F.sum(F.when(~F.col("wild"), F.col("b"))).alias("ab"))
        both = branch.join(node, (F.col("host") == F.col("_h")) & (F.col("node") == F.col("_n")))
        rest_l, share = F.col("al") - F.col("l"), F.col("ab") / F.col("al")
        gap = F.abs(F.col("b") / F.col("l") - (F.col("ab") - F.col("b")) / rest_l)
        error = F.sqrt(share * (1 - share) * (1 / F.col("l") + 1 / rest_l))
        differs = F.coalesce((F.col("l") > 0) & (rest_l > 0) & (gap > z_similar * error), F.lit(False))
        name = (F.when(F.col("wild"), F.col("_b")).when(F.col("k") == 1, F.col("_b"))
                .when(differs, F.col("_b")).otherwise(F.lit("*")))
        named = both.select(F.col("host").alias("_h"), F.col("node").alias("_n"), F.col("_b").alias("_k"),
                            F.concat("node", F.lit("/"), name).alias("_next"), ((F.col("paths") == 1) & (name != "*")).alias("_alone"))
        at = (here.join(named, (F.col("host") == F.col("_h")) & (F.col("node") == F.col("_n")) & (F.col("_b") == F.col("_k")), "left")
              .select(*keep, "_s", "_tail", F.coalesce("_next", "node").alias("node"), F.coalesce("_alone", F.lit(False)).alias("_alone")))
        at = staged(at, "url-level")
        rest = F.transform(F.slice("_s", level + 2, F.size("_s")), lambda s: F.concat(F.lit("/"), F.coalesce(shape(s), s)))
        done.append(at.where("_alone").select(*keep, F.concat("node", F.array_join(rest, ""), "_tail").alias("template")))
        at, level = at.where("NOT _alone").drop("_alone"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def purities(templated: DataFrame, strength: float = PRIOR_STRENGTH) -> DataFrame:
    """(host, template, bad_share): smoothed towards the corpus share."""
    total = templated.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    prior = (total["b"] / total["l"]) if total["l"] else 0.0
    return templated.groupBy("host", "template").agg(
        ((F.sum("bad") + strength * prior) / (F.sum("labelled") + strength)).alias("bad_share"))


def fitting_rules(hosts: DataFrame, rules) -> DataFrame:
    """(host, rules): per host the rules of it and the domains above it, as
    structs (length, path, rule, verdict).  ``rules``: (host, path, verdict)."""
    spark = hosts.sparkSession
    listed = spark.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "_rh string, path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = hosts.select("host").distinct().select("host", F.explode(above).alias("_d"))
    found = domains.join(listed, F.col("_d") == F.col("_rh"))
    return found.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("length"), "path", "rule", "verdict")).alias("rules"))


def verdicts(pages: DataFrame, labels: DataFrame, rules, key: str = "page_id", url: str = "url", max_bad: float = MAX_BAD,
             strength: float = PRIOR_STRENGTH, **tree) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, template, bad_share.  ``labels``: (page_id, bad 0/1)."""
    u = pages[f"`{url}`"]
    own = pages.select(pages[f"`{key}`"].alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    known = (labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").alias("_p"))
             .agg(F.max("bad").alias("_bad")))
    counted = (own.join(known, F.col("page_id") == F.col("_p"), "left").groupBy("host", "path")
               .agg(F.count(F.lit(1)).alias("n"), F.count("_bad").alias("labelled"),
                    F.coalesce(F.sum("_bad"), F.lit(0)).cast("long").alias("bad")))
    templated = staged(templates(counted, **tree), "url-templates")
    judged = templated.join(purities(templated, strength), ["host", "template"]).select(
        F.col("host").alias("_h"), F.col("path").alias("_q"), "template", "bad_share")
    fitting = staged(fitting_rules(own, rules), "url-rules").withColumnRenamed("host", "_rh")
    if fitting.count() <= BROADCAST_HOSTS:
        fitting = F.broadcast(fitting)
    out = (own.join(judged, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_q")), "left")
           .join(fitting, F.col("host") == F.col("_rh"), "left"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return (out.withColumn("_best", best)
            .select("page_id", "host", "path", F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.verdict", F.when(F.col("bad_share") >= max_bad, "block").otherwise("allow")).alias("verdict"),
                    "template", "bad_share"))
