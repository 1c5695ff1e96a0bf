"""Wires between items: name lookups, merging of evidence, counts by kind, hubs and bundles.

Edges are (provider, consumer, kind); evidence is (tier, basis, candidates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.text import clean_import
from graphweft.model import EDGE_KINDS, NO_CODE_FLOW, TIERS, named, rank


def code_flow(edges: DataFrame) -> DataFrame:
    """Edges of every kind but documentation and assets."""
    return edges.where(~F.col("kind").isin(*NO_CODE_FLOW))


def distinct_pairs(edges: DataFrame) -> DataFrame:
    """(provider, consumer) of code wires between two items, each once."""
    return code_flow(edges).where("provider <> consumer").select("provider", "consumer").distinct()


def resolve_files(targets: DataFrame, names: DataFrame) -> DataFrame:
    """The file each target names: the first of seven lookups that finds one.

    targets: target; names: source ('module', 'symbol', 'file'), key, node, scan_order. Of equal keys the last in scan
    order counts. The lookups' keys go into one equi-join and the best rank is kept, so a target costs one probe of
    three keys and no join is repeated.
    """
    last = names.groupBy("source", "key").agg(F.max_by("node", "scan_order").alias("node"))
    whole, cleaned = F.col("target"), clean_import(F.col("target"))
    stem = F.regexp_extract(F.substring_index(cleaned, "/", -1), r"^([^.]*)", 1)
    order = [("module", whole), ("symbol", whole), ("file", whole), ("file", cleaned), ("file", stem), ("symbol", stem), ("module", stem)]
    probes = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(s).alias("source"), k.alias("key")) for i, (s, k) in enumerate(order)))
    asked = targets.select("target").distinct().select("target", F.inline(probes))
    return asked.join(last, ["source", "key"]).groupBy("target").agg(F.min_by("node", "rank").alias("node"), F.min("rank").cast("int").alias("lookup"))


def resolve_members(targets: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """The member a target names (as written, cleaned, or by its last part), else the file.

    members: key, node, scan_order, where the last in scan order wins; files: the result of resolve_files.
    """
    last = members.groupBy("key").agg(F.max_by("node", "scan_order").alias("member"))
    short = F.regexp_extract("target", r"([^.:]+)$", 1)
    probes = F.array(*(F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate((F.col("target"), clean_import(F.col("target")), short))))
    asked = targets.select("target").distinct()
    found = asked.select("target", F.inline(probes)).join(last, "key").groupBy("target").agg(F.min_by("member", "rank").alias("member"))
    return asked.join(found, "target", "left").join(files.select("target", "node"), "target", "left").select("target", "member", F.when(F.col("member").isNull(), F.col("node")).alias("file")).where("member is not null or file is not null")


def file_wires(refs: DataFrame) -> DataFrame:
    """One wire a (provider, consumer): an import outranks a call; proven if any reference is. refs: provider, consumer, kind, proven."""
    best = refs.where("provider <> consumer").groupBy("provider", "consumer").agg(F.min(rank("kind", EDGE_KINDS)).alias("k"), F.bool_or("proven").alias("p"))
    return best.select("provider", "consumer", named("k", EDGE_KINDS).alias("kind"), F.when(F.col("p"), "Proven").otherwise("Unresolved").alias("tier"))


def member_wires(calls: DataFrame) -> DataFrame:
    """One wire a (provider port, consumer port); recursion goes. calls: provider, out_port, consumer, in_port, proven."""
    kept = calls.where(~((F.col("provider") == F.col("consumer")) & (F.col("out_port") == F.col("in_port"))))
    return kept.groupBy("provider", "out_port", "consumer", "in_port").agg(F.when(F.bool_or("proven"), "Proven").otherwise("Unresolved").alias("tier"))


def link_wires(links: DataFrame, files: DataFrame) -> DataFrame:
    """Documentation wires: link targets that are files. links: source, target; files: path."""
    return links.join(files.select(F.col("path").alias("target")), "target", "left_semi").where("source <> target").select(F.col("target").alias("provider"), F.col("source").alias("consumer")).distinct().select("provider", "consumer", F.lit("Documentation").alias("kind"), F.lit("Proven").alias("tier"), F.lit("DocLink").alias("basis"))


def manifest_wires(deps: DataFrame) -> DataFrame:
    """Wires from path dependencies but dev ones; the first entry of a pair keeps its line. deps: provider, consumer, kind, line."""
    kept = deps.where("kind <> 'dev' and provider <> consumer")
    return kept.groupBy("provider", "consumer").agg(F.min("line").alias("line")).select("provider", "consumer", "line", F.lit("Depends").alias("edge_kind"), F.lit("Manifest").alias("basis"))


def reconcile(proven: DataFrame, guessed: DataFrame) -> DataFrame:
    """What path resolution makes of each reference that names matched: upgraded, retargeted, added, dropped, or why not.

    proven: ref, tag ('item', 'external', 'ambiguous', 'unresolved'), target; guessed: ref, target. Counters are per
    reference.
    """
    both = proven.select("ref", "tag", F.col("target").alias("r")).join(guessed.select("ref", F.col("target").alias("g")), "ref", "full_outer")
    item = F.col("tag") == "item"
    outcome = (
        F.when(item & (F.col("r") == F.col("g")), "upgraded").when(item & F.col("g").isNotNull(), "retargeted").when(item, "added")
        .when((F.col("tag") == "external") & F.col("g").isNotNull(), "dropped").when(F.col("tag") == "external", "external").otherwise("unresolved")
    )
    return both.withColumn("outcome", outcome)


def strongest(tiers: Column) -> Column:
    """The strongest tier of a group."""
    return named(F.min(rank(tiers, TIERS)), TIERS)


def merge_links(links: DataFrame) -> DataFrame:
    """One link a (source, target, kind): the strongest tier, then the fewest candidates, brings label and condition.

    links: source, target, kind, tier, candidates, label, condition, evidence array<string>, seq (order of arrival).
    Equal best ranks merge conditions: null if any is null, else the sorted distinct alternatives. Evidence unites.
    """
    ranked = links.withColumn("rank", F.struct(rank("tier", TIERS).alias("t"), F.col("candidates").alias("n")))
    keys = ["source", "target", "kind"]
    best = ranked.withColumn("proof", F.explode_outer("evidence")).groupBy(*keys).agg(F.min("rank").alias("best"), F.array_sort(F.collect_set("proof")).alias("evidence"))
    own = ranked.join(best.select(*keys, "best"), keys).where(F.col("rank") == F.col("best"))
    told = own.withColumn("piece", F.explode_outer(F.split("condition", r" \|\| "))).groupBy(*keys).agg(F.min_by("label", "seq").alias("label"), F.bool_or(F.col("condition").isNull()).alias("always"), F.array_sort(F.collect_set("piece")).alias("alternatives"))
    return best.join(told, keys).select(*keys, named("best.t", TIERS).alias("tier"), F.col("best.n").alias("candidates"), "label", F.when(~F.col("always"), F.array_join("alternatives", " || ")).alias("condition"), "evidence")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of every node, isolated ones with zeros. Ends are counted before the join."""
    ends = edges.select(F.col("provider").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(F.col("consumer").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counted = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.join(counted, "node", "left").select("node", F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"))


def pair_kinds(edges: DataFrame) -> DataFrame:
    """(provider, consumer) with a count of each kind."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in EDGE_KINDS]
    return edges.groupBy("provider", "consumer").agg(*counts)


def bundles(edges: DataFrame, end: DataFrame) -> DataFrame:
    """Wires by the visible ends of both sides: pairs, wires, and the commonest kind (the earlier of equals). One aggregate a pair, one after each end.

    end: node, shown; pairs whose ends show as one go.
    """
    a, b = end.select(F.col("node").alias("provider"), F.col("shown").alias("from_end")), end.select(F.col("node").alias("consumer"), F.col("shown").alias("to_end"))
    half = pair_kinds(edges).join(a, "provider").groupBy("from_end", "consumer").agg(F.count(F.lit(1)).alias("pairs"), *(F.sum(k).alias(k) for k in EDGE_KINDS))
    met = half.join(b, "consumer").where("from_end <> to_end")
    summed = met.groupBy("from_end", "to_end").agg(F.sum("pairs").alias("pairs"), *(F.sum(k).alias(k) for k in EDGE_KINDS))
    wires = sum((F.col(k) for k in EDGE_KINDS), F.lit(0))
    most = F.array_max(F.array(*(F.struct(F.col(k).alias("n"), F.lit(-i).alias("r"), F.lit(k).alias("kind")) for i, k in enumerate(EDGE_KINDS))))
    return summed.select("from_end", "to_end", wires.cast("long").alias("wires"), most["kind"].alias("main_kind"), "pairs")


def hubs(pairs: DataFrame, container: DataFrame, least: int = 8) -> DataFrame:
    """(container, item, consumers): items that at least least siblings, and half of the other connected ones, use.

    pairs: provider, consumer; container: node, container.
    """
    c1, c2 = container.select(F.col("node").alias("provider"), "container"), container.select(F.col("node").alias("consumer"), F.col("container").alias("other"))
    inside = pairs.where("provider <> consumer").distinct().join(c1, "provider").join(c2, "consumer").where("container = other").select("container", "provider", "consumer")
    used = inside.groupBy("container", F.col("provider").alias("item")).agg(F.count(F.lit(1)).alias("consumers"))
    ends = inside.select("container", F.col("provider").alias("item")).unionAll(inside.select("container", "consumer")).distinct()
    connected = ends.groupBy("container").agg(F.count(F.lit(1)).alias("connected"))
    return used.join(connected, "container").where((F.col("consumers") >= least) & (2 * F.col("consumers") >= F.col("connected") - 1)).select("container", "item", "consumers")


def without_hubs(pairs: DataFrame, hub_items: DataFrame) -> DataFrame:
    """pairs without those that a hub provides."""
    return pairs.join(hub_items.select(F.col("item").alias("provider")).distinct(), "provider", "left_anti")


def connection_errors(asked: DataFrame, ports: DataFrame, wires: DataFrame) -> DataFrame:
    """Why each asked connection isn't allowed, or null; ends are put as (output, input).

    asked: id, node_a, port_a, node_b, port_b; ports: node, port, direction ('in', 'out'), data_type ('Any' fits all);
    wires: out_node, out_port, in_node, in_port.
    """
    p = lambda s: ports.select(F.col("node").alias(f"node_{s}"), F.col("port").alias(f"port_{s}"), F.col("direction").alias(f"dir_{s}"), F.col("data_type").alias(f"type_{s}"))
    met = asked.join(p("a"), ["node_a", "port_a"], "left").join(p("b"), ["node_b", "port_b"], "left")
    flip = (F.col("dir_a") == "in") & (F.col("dir_b") == "out")
    end = lambda c, x, y: F.when(flip, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    put = met.select("id", "dir_a", "dir_b", "type_a", "type_b", end("node", "a", "b").alias("out_node"), end("port", "a", "b").alias("out_port"), end("node", "b", "a").alias("in_node"), end("port", "b", "a").alias("in_port"))
    known = put.join(wires.distinct().withColumn("known", F.lit(True)), ["out_node", "out_port", "in_node", "in_port"], "left")
    fits = (F.col("type_a") == F.col("type_b")) | F.col("type_a").eqNullSafe("Any") | F.col("type_b").eqNullSafe("Any")
    error = F.when(F.col("out_node") == F.col("in_node"), "self").when(F.col("dir_a").isNull() | F.col("dir_b").isNull(), "missing port").when(F.col("dir_a") == F.col("dir_b"), "direction").when(~fits, "type").when(F.col("known"), "duplicate")
    return known.select("id", "out_node", "out_port", "in_node", "in_port", error.alias("error"))


WIRE = ["out_node", "out_port", "in_node", "in_port"]


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with those of new whose node isn't there yet."""
    return nodes.unionByName(new.dropDuplicates(["node"]).join(nodes.select("node"), "node", "left_anti").select(*nodes.columns))


def connect(wires: DataFrame, asked: DataFrame, ports: DataFrame, tier: str = "Unresolved", basis: str = "Manual") -> DataFrame:
    """wires (out_node, out_port, in_node, in_port, tier, basis) with the asked connections that nothing speaks against, each once. A port may hold many."""
    fine = connection_errors(asked, ports, wires.select(*WIRE)).where("error is null").select(*WIRE).distinct()
    return wires.unionByName(fine.withColumns({"tier": F.lit(tier), "basis": F.lit(basis)}))


def disconnect(wires: DataFrame, gone: DataFrame) -> DataFrame:
    """wires without those in gone: whole wires, or all at the ends that gone names (any of the four columns of a wire)."""
    return wires.join(gone.select(*(c for c in WIRE if c in gone.columns)).distinct(), [c for c in WIRE if c in gone.columns], "left_anti")


def disconnect_ports(wires: DataFrame, ports: DataFrame) -> DataFrame:
    """wires without any at one of these ports (node, port), on either end."""
    end = lambda side: ports.select(F.col("node").alias(f"{side}_node"), F.col("port").alias(f"{side}_port")).distinct()
    return wires.join(end("out"), ["out_node", "out_port"], "left_anti").join(end("in"), ["in_node", "in_port"], "left_anti").select(*wires.columns)


def set_provenance(wires: DataFrame, told: DataFrame) -> DataFrame:
    """wires with the tier and basis that told (a wire, tier, basis) has for them."""
    new = told.select(*WIRE, F.col("tier").alias("new_tier"), F.col("basis").alias("new_basis")).dropDuplicates(WIRE)
    met = wires.join(new, WIRE, "left").withColumns({"tier": F.coalesce("new_tier", "tier"), "basis": F.coalesce("new_basis", "basis")})
    return met.select(*wires.columns)


def materialised(names: DataFrame, new_names: DataFrame, new_refs: DataFrame) -> DataFrame:
    """Wires of new files into a graph that is there: their references (consumer, target, kind, proven) meet old and new names.

    names, new_names: see resolve_files. Nothing that was wired before is resolved again.
    """
    found = resolve_files(new_refs.select("target"), names.unionByName(new_names))
    return file_wires(new_refs.join(found.select("target", F.col("node").alias("provider")), "target"))


def usable_links(links: DataFrame) -> DataFrame:
    """Distinct (source, target) of links that are proven or possible."""
    return links.where(rank("tier", TIERS) <= 1).select("source", "target").distinct()


def project_stats(edges: DataFrame, shown: tuple[str, ...]) -> DataFrame:
    """(kind, providers, consumers, wires) of the shown kinds, and of all others as 'other'."""
    kind = F.when(F.col("kind").isin(*shown), F.col("kind")).otherwise("other")
    return edges.groupBy(kind.alias("kind")).agg(F.count_distinct("provider").alias("providers"), F.count_distinct("consumer").alias("consumers"), F.count(F.lit(1)).alias("wires"))


def pipeline_stats(links: DataFrame) -> DataFrame:
    """One row: links, by tier, and requests from one source to another."""
    c = lambda e: F.count_if(F.expr(e))
    return links.agg(F.count(F.lit(1)).alias("links"), c("tier = 'Proven'").alias("proven"), c("tier = 'PossibleSet'").alias("possible"), c("tier = 'Unresolved'").alias("unresolved"), c("source <> target and kind = 'Request'").alias("crossings"))


def unresolved_reasons(links: DataFrame) -> DataFrame:
    """(label, n) of unresolved links, the commonest first."""
    return links.where("tier = 'Unresolved'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the nodes gone and every wire at them."""
    ids = gone.select("node").distinct()
    left = edges.join(ids, edges["provider"] == ids["node"], "left_anti").join(ids, edges["consumer"] == ids["node"], "left_anti")
    return nodes.join(ids, "node", "left_anti"), left


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with which, as often as they differ."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionAll(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by order, by a window that keeps one row a key on each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
