"""Call-graph and import-graph queries over vertex and edge tables."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.plans.lineage import cut

# Names so common that a bare call of one says nothing about its target, and names that are called
# through traits and frameworks rather than by name.
COMMON_NAMES = ("new", "from", "default", "get", "set", "path", "fmt", "clone", "len", "build", "init", "main", "run", "next", "into", "parse", "write", "read", "map", "insert", "push", "create", "update", "delete", "value", "name", "id", "to_string", "as_str", "close", "open", "start", "stop", "add", "remove", "send", "call", "apply", "execute")
TRAIT_NAMES = ("fmt", "eq", "ne", "hash", "clone", "default", "drop", "from", "into", "try_from", "deserialize", "serialize", "next", "poll", "deref", "deref_mut", "as_ref", "as_mut", "partial_cmp", "cmp", "to_string", "build", "visit", "index", "add", "sub", "mul", "call", "call_once", "call_mut", "new")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """(node, depth): least number of edges from the seeds, up to a depth, along them or in both directions.  edges: (src, dst); seeds: (node).

    Edges are written once, as they come; a round joins them with its front, which is small or not, as the planner sees.
    """
    edges = cut(edges.select("src", "dst"))
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        own = front.select("node")
        nxt = edges.join(own, edges["src"] == own["node"]).select(F.col("dst").alias("node"))
        if both:
            nxt = nxt.unionByName(edges.join(own, edges["dst"] == own["node"]).select(F.col("src").alias("node")))
        front = cut(nxt.distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def impact_radius(edges: DataFrame, seeds: DataFrame, depth: int, most: int, kind: str | None = "CALLS", nodes: DataFrame | None = None) -> DataFrame:
    """(node, min_depth, truncated): what seeds reach over edges in both directions, nearest first, at most `most`.

    `truncated` is true when the cap is reached, also by exactly as many.  Targets that are no node are dropped after the cap.
    """
    own = edges.filter(F.col("kind") == kind) if kind else edges
    pairs = own.select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    # A node is seen at one depth only.
    got = bfs(pairs, seeds, depth, both=True).withColumnRenamed("depth", "min_depth")
    top = got.orderBy("min_depth", "node").limit(most)
    count = top.agg((F.count("*") >= most).alias("truncated"))
    out = top.join(F.broadcast(count))
    return out.join(nodes.select(F.col("qualified_name").alias("node")), "node", "left_semi") if nodes is not None else out


def last_segment(qn: Column) -> Column:
    return F.element_at(F.split(qn, "::"), -1)


def last_two(qn: Column) -> Column:
    parts = F.split(qn, "::")
    return F.when(F.size(parts) >= 3, F.concat_ws("::", F.element_at(parts, -2), F.element_at(parts, -1)))


def module_prefix(path: Column) -> Column:
    """The first folder of a path; in a workspace the member's folder below it."""
    return F.regexp_extract(F.translate(path, "\\", "/"), r"^(crates/[^/]+|[^/]*)", 1)


def definitions(nodes: DataFrame) -> DataFrame:
    """For each name the files that define it: (name, files, one_file)."""
    return nodes.filter("kind <> 'File'").groupBy("name").agg(F.countDistinct("file_path").alias("files"), F.min("file_path").alias("one_file"))


def module_definitions(nodes: DataFrame) -> DataFrame:
    """For each name and module how many files define it."""
    return nodes.filter("kind <> 'File'").groupBy("name", module_prefix(F.col("file_path")).alias("prefix")).agg(F.countDistinct("file_path").alias("files_here"))


# Stand for files that aren't known: they are equal to no path, nor to each other.
NO_CALLER_FILE, NO_TARGET_FILE = "\0", "\1"


#: Groups of a caller's calls by one name with at most so many longer ones are made distinct row by row.
WAYS = 64

#: Calls by more than a name.
LONG = "instr(t, '::') > 0"


def bare_calls(edges: DataFrame) -> DataFrame:
    """(caller, c_file, t, name, clear, mixed, others): distinct calls and the last segment of what they name.

    All ways to a node end in its name, so only calls of one group (caller, name) find the same node.  In a `clear` group, of
    one file and at most WAYS calls by more than a name, `others` has what the others say (null if nothing): a pair is then
    left out where another call gives it, and pairs need no shuffle to be distinct.  `mixed` groups have bare calls and longer
    ones.  Written once: each way to a node reads other columns of it, and no exchange would serve two of them.
    """
    calls = edges.filter("kind = 'CALLS'").select(F.col("source_qualified").alias("caller"), F.coalesce("file_path", F.lit(NO_CALLER_FILE)).alias("c_file"), F.col("target_qualified").alias("t")).distinct()
    w = Window.partitionBy("caller", "name")
    long = F.count(F.when(F.expr(LONG), 1)).over(w)
    calls = calls.withColumn("name", last_segment(F.col("t")))
    calls = calls.withColumn("clear", (F.min("c_file").over(w) == F.max("c_file").over(w)) & (long <= WAYS)).withColumn("mixed", (long > 0) & (long < F.count("*").over(w)))
    calls = calls.withColumn("others", F.collect_list(F.when(F.col("clear") & F.expr(LONG), F.col("t"))).over(w))
    return cut(calls.withColumn("others", F.when(F.size("others") > F.when(F.expr(LONG), 1).otherwise(0), F.col("others"))))


def unsaid(*ways: Column) -> Column:
    """Whether no other call of a clear group names the node in one of these ways."""
    return ~F.coalesce(F.arrays_overlap("others", F.array(*ways)), F.lit(False))


def targets(nodes: DataFrame) -> DataFrame:
    """(target, t_file, name, parent_name, is_file, odd): distinct nodes; `odd` are those whose ways their full name doesn't tell."""
    n = nodes.select(F.col("qualified_name").alias("target"), F.coalesce("file_path", F.lit(NO_TARGET_FILE)).alias("t_file"), "name", "parent_name", (~F.coalesce(F.col("kind") != "File", F.lit(False))).alias("is_file")).distinct()
    told = F.col("name").eqNullSafe(last_segment(F.col("target"))) & F.concat("parent_name", F.lit("::"), "name").eqNullSafe(last_two(F.col("target")))
    return cut(n.withColumn("odd", F.max(~told).over(Window.partitionBy("target"))))


def once(pairs: DataFrame, *cols: str) -> DataFrame:
    """Distinct pairs; those of clear groups come once and aren't shuffled for it.

    The filters reach the calls, so that each call is shuffled for one of the two.
    """
    return pairs.filter("clear").select(*cols).unionByName(pairs.filter("not clear").select(*cols).distinct())


def by_full_name(calls: DataFrame, n: DataFrame, few: bool = False) -> DataFrame:
    """(target, caller, clear): calls by more than a name, of a node by its full name or by its type and name."""
    names = n.select("target", F.explode(F.array_compact(F.array("target", last_two(F.col("target"))))).alias("t")).distinct()
    found = calls.filter(LONG).select("caller", "t", "clear", "others").join(names.hint("broadcast" if few else "merge"), "t")
    return found.filter((F.col("t") == F.col("target")) | unsaid(F.col("target"))).select("target", "caller", "clear")


def loose(n: DataFrame) -> DataFrame:
    """(name, target): nodes whose full name is one that a bare call can have."""
    return n.filter("instr(target, '::') = 0").select(F.col("target").alias("name"), "target").distinct()


def callers_typed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, caller): calls of a node by its full name or by its type and name."""
    calls, n = bare_calls(edges), targets(nodes)
    bare = calls.filter(f"not ({LONG})").select("caller", "name", "clear").join(loose(n).hint("merge"), "name")
    return once(by_full_name(calls, n).unionByName(bare.select("target", "caller", "clear")), "target", "caller")


def places(nodes: DataFrame, n: DataFrame) -> DataFrame:
    """(name, t_file, prefix, files, files_here): each file that defines a name, how many files do, and how many of its module.

    Joins with what comes from nodes are never broadcasts: rows of a few numbers become rows of texts, which no estimate sees.
    """
    at = n.select("name", "t_file").distinct().join(definitions(nodes).select("name", "files").hint("merge"), "name").withColumn("prefix", module_prefix(F.col("t_file")))
    return cut(at.join(module_definitions(nodes).hint("merge"), ["name", "prefix"], "left"))


def without_files(at: DataFrame, sites: DataFrame, local: bool) -> DataFrame:
    """(name, c_file, t_file) for the files that call a name: the file that defines it alone or alone in the caller's module; also the caller's own, if `local`.

    Each case has its own equality, so that a name that many files define and many call is never joined with itself.
    """
    rare = sites.filter(~F.col("name").isin(*COMMON_NAMES))
    out = rare.join(at.filter("files = 1").select("name", "t_file").hint("merge"), "name")
    here = at.filter("files_here = 1").select("name", "prefix", "t_file")
    out = out.unionByName(rare.withColumn("prefix", module_prefix(F.col("c_file"))).join(here.hint("merge"), ["name", "prefix"]).select("name", "c_file", "t_file"))
    if local:
        out = out.unionByName(sites.join(at.select("name", F.col("t_file").alias("c_file"), "t_file").hint("merge"), ["name", "c_file"]))
    return out.select("name", "c_file", "t_file")


#: Imports are matched with stems by keys of so many letters at most.
KEY = 8


def evidence(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(c_file, stem): files whose imports hold the stem of a file's name; `_` and `%` of a stem stand for anything.

    A stem's first letters without such are a key, and so is each run of letters of an import.
    """
    imports = edges.filter("kind = 'IMPORTS_FROM'").select(F.col("file_path").alias("c_file"), F.col("target_qualified").alias("imported")).distinct()
    stems = at.select("stem").distinct().withColumn("key", F.substring(F.regexp_extract("stem", r"([^%_\\\\]*)", 1), 1, KEY))
    size = F.length("imported")
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.lit(KEY)), lambda k: F.substring(F.col("imported"), i, k))
    keys = F.array_distinct(F.concat(F.array(F.lit("")), F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(1), size), runs))).otherwise(F.array().cast("array<string>"))))
    texts = imports.select("imported").distinct().withColumn("key", F.explode(keys))
    found = texts.join(stems.hint("merge"), "key").filter(F.expr("imported like concat('%', stem, '%')")).select("imported", "stem")
    return imports.join(found.hint("merge"), "imported").select("c_file", "stem").distinct()


def callers(nodes: DataFrame, edges: DataFrame, low_confidence: bool = False, of: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(target, caller) with bare names resolved; of some targets (node), if given, which may be few enough to broadcast.

    A bare call is of a node if the name is not too common (then only within the file) and the node's is the only
    definition, or in the caller's file, or the only one in the caller's module, or in a file that the caller's imports.
    Files decide that, so it is settled between the files that call a name and those that define it, and joined with calls then.
    """
    calls, n = bare_calls(edges), targets(nodes)
    if of is not None:
        n = n.join(of.select(F.col("node").alias("target")), "target", "left_semi")
    exact = by_full_name(calls, n, few)
    # Here a node's name is the last segment of its full one.
    t = n.filter("not is_file").select("target", "t_file", last_segment(F.col("target")).alias("name"))
    bare = calls.filter(f"not ({LONG})").select("caller", "c_file", "name", "clear", "others")
    if low_confidence:
        named = t.select("name", "target").distinct().join(definitions(nodes).select("name").hint("merge"), "name", "left_semi")
        found = bare.join(named.unionByName(loose(n)).distinct().hint("merge"), "name")
    else:
        at, sites = places(nodes, t), cut(bare.select("name", "c_file").distinct())
        kept = without_files(at, sites, True)
        stem = at.withColumn("stem", F.regexp_extract("t_file", r"([^/]*?)(\.[^./]*)?$", 1))
        rare = sites.filter(~F.col("name").isin(*COMMON_NAMES))
        evident = rare.join(stem.select("name", "t_file", "stem").hint("merge"), "name").join(evidence(edges, stem), ["c_file", "stem"], "left_semi")
        kept = kept.unionByName(evident.select("name", "c_file", "t_file"))
        means = kept.join(t.hint("merge"), ["name", "t_file"]).select("name", "c_file", "target").unionByName(sites.join(loose(n).hint("merge"), "name").select("name", "c_file", "target"))
        # Dealt by the key of the join that follows, which also makes them distinct.
        means = means.repartition("name", "c_file").distinct()
        found = bare.join(means if few else means.hint("merge"), ["name", "c_file"])
    found = found.filter(unsaid(F.col("target"), last_two(F.col("target")))).select(*exact.columns)
    return once(exact.unionByName(found), "target", "caller")


def meant(nodes: DataFrame, n: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, c_file, target, odd, full, local): what a bare name means in a file that calls it: a node of that full name, those of the file, or else of the one that defines it."""
    sites = cut(calls.filter(f"not ({LONG})").select("name", "c_file").distinct())
    own, at = n.select("name", "t_file", "target", "odd").distinct(), places(nodes, n)
    filed = sites.filter(F.col("c_file") != NO_CALLER_FILE)
    # A site with a definition in its own file means no other.
    elsewhere = filed.join(at.select("name", F.col("t_file").alias("c_file")).hint("merge"), ["name", "c_file"], "left_anti")
    files = without_files(at, elsewhere, False).withColumn("local", F.lit(False)).unionByName(filed.select("name", "c_file", F.col("c_file").alias("t_file"), F.lit(True).alias("local")))
    cols = ("name", "c_file", "target", "odd", "full", "local")
    found = files.join(own.hint("merge"), ["name", "t_file"]).withColumn("full", F.lit(False)).select(*cols)
    whole = loose(n).join(n.select("target", "odd").distinct().hint("merge"), "target")
    found = found.unionByName(sites.join(whole.hint("merge"), "name").withColumn("full", F.lit(True)).withColumn("local", F.lit(False)).select(*cols))
    # Dealt by the key of the join that follows, which also brings a target's rows together.
    return found.repartition("name", "c_file").groupBy("name", "c_file", "target").agg(*(F.max(c).alias(c) for c in cols[3:]))


def callee_pairs(calls: DataFrame, n: DataFrame, means: DataFrame) -> DataFrame:
    """(caller, target): what calls mean, distinct; odd nodes' pairs and those of groups that aren't clear are shuffled for it."""
    cols, target = ("caller", "target", "clear", "odd"), F.col("target")
    # Full names and those of a type and a name are ways of one join.  A node of both in one text is found in full.
    typed = F.concat("parent_name", F.lit("::"), "name")
    ways = n.select("target", "odd", F.col("target").alias("t"), F.lit(True).alias("full")).unionByName(n.select("target", "odd", typed.alias("t"), F.lit(False).alias("full")).filter("size(split(t, '::')) = 2"))
    ways = ways.groupBy("t", "target").agg(F.max("full").alias("full"), F.max("odd").alias("odd"))
    long = calls.filter(LONG).select("caller", "t", "clear", "others").join(ways.hint("merge"), "t")
    long = long.filter(F.col("odd") | F.col("full") | unsaid(target)).select(*cols)
    bare = calls.filter(f"not ({LONG})").select("caller", "c_file", "name", "clear", "others").join(means.hint("merge"), ["name", "c_file"])
    bare = bare.filter(F.col("odd") | unsaid(target, last_two(target)))
    # A caller with a definition in its own file means no other, in whichever of its files.
    vague = bare.filter("not clear")
    local = vague.filter("local").select("caller", "name").distinct()
    there = vague.filter("not (full or local)").join(local.hint("merge"), ["caller", "name"], "left_anti")
    vague = vague.filter("full or local").select(*cols).unionByName(there.select(*cols))
    sole, shared = [x.filter("clear") for x in (long, bare)], [long.filter("not clear"), vague]
    if not n.filter("odd").isEmpty():
        shared += [x.filter("odd") for x in sole]
        sole = [x.filter("not odd") for x in sole]
    union = lambda of: functools.reduce(DataFrame.unionByName, [x.select("caller", "target") for x in of])
    return union(sole).unionByName(union(shared).distinct())


def callees(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(caller, target): targets by full name, by type and name, and bare names that one definition can mean; of some callers (node), if given."""
    calls, n = bare_calls(edges), targets(nodes.filter("kind <> 'File'"))
    if of is not None:
        calls = calls.join(of.select(F.col("node").alias("caller")), "caller", "left_semi")
    return callee_pairs(calls, n, meant(nodes, n, calls))


#: Starts of a step that go to every executor.
FEW = 1 << 14


def expand_calls(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(node, hops, via): what seeds (node) reach in so many steps over callers and callees, and how at its first step: caller, callee, test.

    A caller that is a test is also a `test`.  Seeds are not among the rows.  Calls are resolved for what a step starts from.
    """
    tests = nodes.filter("is_test").select(F.col("qualified_name").alias("node"))
    edges = cut(edges)
    seen = front = cut(seeds.select("node").distinct())
    out = None
    for k in range(1, hops + 1):
        few = front.count() <= FEW
        front = front.hint("broadcast" if few else "merge")
        back = callers(nodes, edges, of=front, few=few).select(F.col("caller").alias("node"), F.lit("caller").alias("via"))
        forth = callees(nodes, edges, of=front).select(F.col("target").alias("node"), F.lit("callee").alias("via"))
        got = back.unionByName(forth).distinct().join(seen, "node", "left_anti")
        got = cut(got.unionByName(got.filter("via = 'caller'").join(tests.hint("merge"), "node", "left_semi").select("node", F.lit("test").alias("via"))).distinct().withColumn("hops", F.lit(k)))
        front = cut(got.select("node").distinct())
        seen = seen.unionByName(front)
        out = got if out is None else out.unionByName(got)
    return out.groupBy("node", "hops").agg(F.array_sort(F.collect_set("via")).alias("via"))


def coupling(modules: DataFrame, imports: DataFrame, key: str = "path", src: str = "src", dst: str = "dst") -> DataFrame:
    """(key, fan_in, fan_out) of every module, over edges between modules."""
    inside = imports.join(modules.select(F.col(key).alias(src)), src, "left_semi").join(modules.select(F.col(key).alias(dst)), dst, "left_semi")
    fan_in = inside.groupBy(F.col(dst).alias(key)).agg(F.count("*").alias("fan_in"))
    fan_out = inside.groupBy(F.col(src).alias(key)).agg(F.count("*").alias("fan_out"))
    return modules.select(key).join(fan_in, key, "left").join(fan_out, key, "left").fillna(0, ["fan_in", "fan_out"])


def adaptive_threshold(coupled: DataFrame) -> DataFrame:
    """One row: max(2 x the upper median of positive fan-ins, 3); the median is 1 where there is none.

    The upper median is the discrete one of the falling order; an aggregate of distinct values and their counts.
    """
    median = F.expr("percentile_disc(0.5) within group (order by fan_in desc)")
    return coupled.filter("fan_in > 0").agg(F.greatest(2 * F.coalesce(median, F.lit(1)), F.lit(3)).cast("long").alias("threshold"))


def dead_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and classes that no call names, in full, bare or by parent.

    Tests, entry points and what is called through traits are never dead.
    """
    path = F.concat(F.lit("/"), F.translate("file_path", "\\", "/"))
    alive = F.col("is_test") | F.col("name").isin("main", *TRAIT_NAMES) | path.rlike(r"/(tests?|bin)/|/build\.rs$")
    called = edges.filter("kind = 'CALLS'").select(F.col("target_qualified").alias("t")).distinct()
    c = nodes.filter("kind in ('Function', 'Class')").filter(~alive)
    c = c.join(called, c["qualified_name"] == called["t"], "left_anti").join(called, c["name"] == called["t"], "left_anti")
    typed = F.concat_ws("::", F.col("parent_name"), F.col("name"))
    return c.join(called, (F.col("parent_name").isNotNull()) & (typed == called["t"]), "left_anti")


def local_components(s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of the edges s -> d, a component being named by its least node: depth-first, without recursion."""
    nodes, at = np.unique(np.concatenate([s, d]), return_inverse=True)
    a, b = at[: len(s)], at[len(s) :]
    by = np.argsort(a, kind="stable")
    out, first = b[by].tolist(), np.searchsorted(a[by], np.arange(len(nodes) + 1)).tolist()
    low, number, name = [-1] * len(nodes), [-1] * len(nodes), [-1] * len(nodes)
    held: list[int] = []
    count = 0
    for root in range(len(nodes)):
        if number[root] >= 0:
            continue
        work = [(root, first[root])]
        number[root] = low[root] = count
        count += 1
        held.append(root)
        while work:
            v, k = work.pop()
            if k < first[v + 1]:
                work.append((v, k + 1))
                w = out[k]
                if number[w] < 0:
                    number[w] = low[w] = count
                    count += 1
                    held.append(w)
                    work.append((w, first[w]))
                elif name[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            if low[v] == number[v]:
                own = []
                while not own or own[-1] != v:
                    own.append(held.pop())
                least = min(own)
                for w in own:
                    name[w] = least
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return nodes, nodes[np.array(name, np.int64)] if len(nodes) else nodes


def scc(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 200, local: int = 1 << 20) -> DataFrame:
    """(node, component, size) of cycles: strongly connected components of two nodes and more, named by their least node.

    Forward-backward colouring: every node takes the least label that reaches it, and what reaches a label's own node
    within its colour is its component; the rest goes on.  Nodes without edges in or out are peeled off.  Once no more
    than `local` edges of whole numbers are left, one task finds their components.
    """
    left = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s <> d").distinct())
    whole = all(t in ("bigint", "int", "smallint", "tinyint") for _, t in left.dtypes)
    done = None
    for _ in range(most_rounds):
        n = left.count()
        while n > (local if whole else 0):
            trimmed = cut(left.join(left.select(F.col("d").alias("s")).distinct(), "s", "left_semi").join(left.select(F.col("s").alias("d")).distinct(), "d", "left_semi").select("s", "d"))
            before, n, left = n, trimmed.count(), trimmed
            if n == before:
                break
        if whole and 0 < n <= local:

            def one(t: pa.Table) -> pa.Table:
                node, comp = local_components(t.column("s").to_numpy().astype(np.int64), t.column("d").to_numpy().astype(np.int64))
                return pa.table({"n": node, "c": comp})

            own = left.groupBy(F.lit(0).alias("all")).applyInArrow(one, "n long, c long")
            done = own if done is None else done.unionByName(own)
            break
        if left.isEmpty():
            break
        nodes = left.select(F.col("s").alias("n")).union(left.select("d")).distinct()
        colour = cut(nodes.withColumn("c", F.col("n")))
        while True:
            push = left.join(colour.select(F.col("n").alias("s"), "c"), "s").groupBy(F.col("d").alias("n")).agg(F.min("c").alias("m"))
            nxt = cut(colour.join(push, "n", "left").select("n", F.least("c", F.coalesce("m", "c")).alias("c")))
            same = nxt.join(colour, ["n", "c"], "left_anti").isEmpty()
            colour = nxt
            if same:
                break
        inside = cut(left.join(colour.select(F.col("n").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("n").alias("d"), F.col("c").alias("cd")), "d").filter("cs = cd").select("s", "d", F.col("cs").alias("c")))
        back = cut(colour.filter("n = c"))
        front = back
        while not front.isEmpty():
            nxt = inside.join(front.select(F.col("n").alias("d"), "c"), ["d", "c"]).select(F.col("s").alias("n"), "c").distinct()
            front = cut(nxt.join(back, ["n", "c"], "left_anti"))
            back = cut(back.unionByName(front))
        done = back if done is None else done.unionByName(back)
        left = cut(inside.join(back.select(F.col("n").alias("s")), "s", "left_anti").join(back.select(F.col("n").alias("d")), "d", "left_anti").select("s", "d"))
    if done is None:
        return left.select(F.col("s").alias("node"), F.col("s").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    size = F.count("*").over(Window.partitionBy("c"))
    return done.withColumn("size", size).filter("size > 1").select(F.col("n").alias("node"), F.col("c").alias("component"), "size")


def coverage_map(edges: DataFrame, tests: DataFrame, depth: int = 3) -> DataFrame:
    """(function, test, hops): what each test reaches over calls, at least hops.  edges: (src, dst); tests: (test)."""
    edges = cut(edges)
    front = cut(tests.select("test", F.col("test").alias("node"), F.lit(0).alias("hops")))
    seen = front
    for d in range(1, depth + 1):
        nxt = front.join(edges, front["node"] == edges["src"]).select("test", F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(seen.select("test", "node"), ["test", "node"], "left_anti").withColumn("hops", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hops > 0").join(tests.select(F.col("test").alias("node")), "node", "left_anti").select(F.col("node").alias("function"), "test", "hops")


def suggest_tests(coverage: DataFrame, changed: DataFrame) -> DataFrame:
    """(test, covers, hops) for changed functions, most covering first."""
    got = coverage.join(changed.select("function").distinct(), "function", "left_semi")
    return got.groupBy("test").agg(F.countDistinct("function").alias("covers"), F.min("hops").alias("hops"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place from 0 in an order over the whole table, in two levels: in its partition of the sorted rows, and over the partitions' counts."""
    at = F.monotonically_increasing_id()
    part = cut(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", at - F.spark_partition_id().cast("long") * (1 << 33)))
    counts = part.groupBy("_p").agg(F.count("*").alias("_n"))
    # A row for each partition.
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return part.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def community_sizes(members: DataFrame, label: str) -> DataFrame:
    """(label, size, community): communities numbered by size from 0, equals by label."""
    sizes = members.groupBy(label).agg(F.count("*").alias("size"))
    return numbered(sizes, [F.desc("size"), F.col(label)], "community")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community, size): each node takes the heaviest label around it, the least of equals; communities are numbered by size from 0.

    A deterministic stand-in for modularity optimisation; edges: (a, b, weight).
    """
    both = cut(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for step in range(rounds):
        votes = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("label")).alias("neg"))).alias("m"))
        nxt = best.select(F.col("a").alias("node"), (-F.col("m.neg")).alias("new"))
        # Every other node moves in a round: two nodes never swap labels for ever.
        moved = cut(label.join(nxt, "node").select("node", F.when(F.pmod(F.hash("node"), F.lit(2)) == step % 2, F.col("new")).otherwise(F.col("label")).alias("label")))
        same = moved.join(label, ["node", "label"], "left_anti").isEmpty()
        label = moved
        if same and step % 2:
            break
    return label.join(community_sizes(label, "label"), "label").select("node", "community", "size")
