"""Relational jobs over catalogues, dependency edges, archives, listings and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .scans import with_dimension

# --- archives and dependencies


def class_entry(name: Column) -> Column:
    return F.concat(F.replace(name, F.lit("."), F.lit("/")), F.lit(".class"))


#: Equal rows that one row stands for at most before they are written out.
COPIES = 1 << 16


def locate_class(names: DataFrame, archives: DataFrame, copies: int = COPIES) -> DataFrame:
    """Archives that hold each class (name), or a message where none does; a row for each pair, equal ones too.

    Equal names, and equal entries of an archive, are counted and meet once.  The rows that a pair
    stands for are dealt to all tasks in runs of ``copies`` at most, so a name that is common on both sides is no single task.
    """
    asked = names.groupBy("name").agg(F.count("*").alias("_n")).withColumn("entry", class_entry(F.col("name")))
    held = archives.groupBy("entry", "archive").agg(F.count("*").alias("_m"))
    found = asked.join(held, "entry", "left").withColumn("_n", F.col("_n") * F.coalesce("_m", F.lit(1)))
    runs = found.select("name", "archive", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / copies))).alias("_run"))
    size = F.least(F.lit(copies), F.col("_n") - F.col("_run") * copies).cast("int")
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: runs are few bytes, which would all come to one task otherwise
    dealt = runs.select("name", F.coalesce("archive", F.concat(F.lit("not found: "), F.col("name"))).alias("archive"), size.alias("_n")).repartition(tasks)
    return dealt.select("name", "archive", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("col")


def outer_class(entry: Column) -> Column:
    return F.regexp_replace(entry, r"\$[^/]*\.class$", ".class")


def shadowed_classes(archives: DataFrame) -> DataFrame:
    """Classes in more than one archive; a nested class counts as its enclosing one."""
    return archives.withColumn("entry", outer_class(F.col("entry"))).groupBy("entry").agg(F.count_distinct("archive").alias("n")).filter("n > 1")


def archives_with_entry(archives: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs where the quoted name stands in the archive's text after its first character.

    What stands between two quotes of a text is taken out and joined by equality; only names that
    hold a quote themselves are looked for in the texts.
    """
    between = F.slice(F.split("text", '"', -1), 2, F.greatest(F.size(F.split("text", '"', -1)) - 2, F.lit(0)))
    # a name that is found at the very start is not looked for further on
    quoted = F.when(F.col("text").startswith('"'), F.expr("filter(_q, q -> q <> _q[0])")).otherwise(F.col("_q"))
    found = archives.withColumn("_q", between).select("archive", F.explode(F.array_distinct(quoted)).alias("name"))
    plain = found.join(names.filter(~F.col("name").contains('"')), "name").select("archive", "name")
    odd = archives.join(names.filter(F.col("name").contains('"')), F.expr("""instr(text, concat('"', name, '"')) > 1"""))
    return plain.unionByName(odd.select("archive", "name"))


def direct_dependencies(files: DataFrame, edges: DataFrame) -> DataFrame:
    return files.join(edges.select(F.col("src").alias("file"), "dst"), "file", "left").select("file", F.coalesce("dst", F.lit("Not found")).alias("dependency"))


#: Words of 64 roots in a row of the closure, and the roots that a group of them is meant to hold.
_WORDS = 8
_FILL = _WORDS * 56


def _numbered_roots(roots: DataFrame) -> DataFrame:
    """(root, _g, _at): distinct roots in groups, and their bit in it; no window holds more than about a group."""
    roots = roots.select("root").distinct()
    groups = max(1, -(-roots.count() // _FILL))
    dealt = roots.withColumn("_h", F.pmod(F.xxhash64("root"), F.lit(groups)))
    nth = F.row_number().over(Window.partitionBy("_h").orderBy("root")) - 1
    place = dealt.withColumn("_n", nth)
    return place.select("root", (F.col("_h") + F.lit(groups) * F.floor(F.col("_n") / (64 * _WORDS))).alias("_g"), (F.col("_n") % (64 * _WORDS)).cast("int").alias("_at"))


def transitive_dependents(edges: DataFrame, roots: DataFrame, work: Workspace) -> DataFrame:
    """(root, file): all files that depend on each of the given (root), itself included; one frontier join a round, cycles are met once.

    A row of the rounds is a file and a group of 512 roots, with a bit for each root that reaches it,
    so an edge is gone along once for all roots of a group.  The edges are written once; what was
    reached is one table a round, so that no round runs the earlier ones again.
    """
    edges = work.table(edges.select("src", F.col("dst").alias("file")), "edges")
    numbered = work.table(_numbered_roots(roots), "roots")
    bits, old = [f"_b{w}" for w in range(_WORDS)], [f"_s{w}" for w in range(_WORDS)]
    none = F.lit(0).cast("long")
    own = [F.bit_or(F.when(F.floor(F.col("_at") / 64) == w, F.expr("shiftleft(1L, _at % 64)")).otherwise(none)).alias(b) for w, b in enumerate(bits)]
    seen = frontier = work.table(numbered.groupBy(F.col("root").alias("file"), "_g").agg(*own), "front-0")
    step = 0
    while True:
        step += 1
        met = edges.join(frontier, "file").select(F.col("src").alias("file"), "_g", *bits, *(none.alias(s) for s in old))
        before = seen.select("file", "_g", *(none.alias(b) for b in bits), *(F.col(b).alias(s) for b, s in zip(bits, old, strict=True)))
        both = met.unionByName(before).groupBy("file", "_g").agg(*(F.bit_or(c).alias(c) for c in [*bits, *old]))
        new = both.select("file", "_g", *(F.col(b).bitwiseAND(F.bitwise_not(s)).alias(b) for b, s in zip(bits, old, strict=True)))
        frontier = work.table(new.filter(" or ".join(f"{b} <> 0" for b in bits)), f"front-{step}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    # what is reached in one round is not in another's table
    held = F.expr("flatten(array(" + ", ".join(f"transform(filter(sequence(0, 63), i -> getbit({b}, i) = 1), i -> i + {64 * w})" for w, b in enumerate(bits)) + "))")
    reached = seen.select("file", "_g", F.explode(held).alias("_at"))
    return with_dimension(reached, numbered, ["_g", "_at"]).select("root", "file")


def reverse_index(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("dependents"))


# --- sets


def missing_imports(tokens: DataFrame, imported: DataFrame, known: DataFrame) -> DataFrame:
    """Known classes (name, package) that a document's tokens name and do not import, by package."""
    missing = tokens.join(imported, ["doc_id", "tok"], "left_anti")
    return missing.join(known.withColumnRenamed("name", "tok"), "tok").groupBy("doc_id", "package").agg(F.array_join(F.array_sort(F.collect_set("tok")), ",").alias("names"))


def new_ignore_rules(rules: DataFrame, known: DataFrame) -> DataFrame:
    """Rules (module, line) prefixed with their module, without comments, that are not known (line)."""
    own = rules.filter(~F.col("line").startswith("#")).select(F.concat(F.lit("/"), "module", F.lit("/"), "line").alias("line"))
    return own.subtract(known)


def listing_diff(published: DataFrame, generated: DataFrame) -> DataFrame:
    added = generated.exceptAll(published).withColumn("change", F.lit("+"))
    return added.unionByName(published.exceptAll(generated).withColumn("change", F.lit("-")))


# --- hierarchies


def menu_tree(paths: DataFrame) -> DataFrame:
    """(path, parent) of every menu and its ancestors; a trailing > is ignored."""
    parts = F.split(F.regexp_replace("menu_path", ">$", ""), ">")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ">"))
    return paths.select(F.explode(up).alias("path")).distinct().withColumn("parent", F.when(F.col("path").contains(">"), F.regexp_replace("path", ">[^>]*$", "")))


def name_conflicts(entries: DataFrame) -> DataFrame:
    """Entries whose name came before: the first keeps it, the others are refused."""
    first = entries.groupBy("name").agg(F.min("entry_id").alias("_first"))
    return entries.join(first, "name").filter("entry_id > _first").select("entry_id", "name", F.col("_first").alias("kept_id"))


def render_listing(catalog: DataFrame) -> DataFrame:
    """Lines of a nested listing: a section's entries before its sub-sections, sorted, heading depth by level."""
    tree = menu_tree(catalog)
    depth = lambda p: F.size(F.split(p, ">"))
    mark = F.repeat(F.lit("="), depth(F.col("path")))
    # "!" sorts before every path: entries come first in their section
    sections = tree.select(F.concat(F.replace("path", F.lit(">"), F.lit(">~")), F.lit(">!")).alias("key"), F.lit("").alias("name"), F.concat(mark, F.lit(" "), F.regexp_replace("path", "^.*>", ""), F.lit(" "), mark).alias("line"))
    entries = catalog.select(F.concat(F.replace("menu_path", F.lit(">"), F.lit(">~")), F.lit(">!")).alias("key"), "name", F.concat(F.lit("* "), "name").alias("line"))
    return sections.unionByName(entries).orderBy("key", "name")


# --- documentation


def _listed(items: DataFrame, lacking: str) -> DataFrame:
    return items.select(F.concat(F.initcap("kind"), F.lit(f"s without {lacking}")).alias("list"), "href").distinct()


def undocumented(items: DataFrame, documented: DataFrame) -> DataFrame:
    """(list, href) of the items (kind, href) without a page; one list for each kind."""
    return _listed(items.join(documented.select("href"), "href", "left_anti"), "documentation page")


def unmaintained(items: DataFrame, documented: DataFrame, maintainers: DataFrame) -> DataFrame:
    """(list, href) of the items that have a page but no maintainer; one list for each kind."""
    kept = maintainers.filter("maintainer is not null").select("href")
    return _listed(items.join(documented.select("href"), "href", "left_semi").join(kept, "href", "left_anti"), "maintainer")


def items_by_maintainer(items: DataFrame) -> DataFrame:
    """(maintainer, kind, items): sorted; rows without maintainer are left out."""
    return items.filter("maintainer is not null").groupBy("maintainer", "kind").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))


def first_package(links: DataFrame) -> DataFrame:
    """The first place of each package in page order."""
    first = links.groupBy("package").agg(F.min(F.struct("page_id", "pos")).alias("_f"))
    return first.select("package", F.col("_f.page_id").alias("page_id"), F.col("_f.pos").alias("pos"))


def rename_plan(names: DataFrame, old: str, new: Column) -> DataFrame:
    """(old, new, collides): changed names, and whether the new one exists already."""
    plan = names.select(F.col(old).alias("old"), new.alias("new")).filter("old <> new").distinct()
    taken = names.select(F.col(old).alias("new"), F.lit(True).alias("_t")).distinct()
    return plan.join(taken, "new", "left").select("old", "new", F.coalesce("_t", F.lit(False)).alias("collides"))


def missing_versions(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (file, checksum, ts) to add: known file, unseen checksum; unknown files are marked as ignored."""
    files = known.select("file").distinct().withColumn("_k", F.lit(True))
    new = candidates.join(known.select("file", "checksum"), ["file", "checksum"], "left_anti")
    return new.join(files, "file", "left").select("file", "checksum", F.when(F.col("_k"), "add").otherwise("ignore").alias("action"))


def ensure_layers(balls: DataFrame, layers: DataFrame) -> DataFrame:
    """Balls with the id of their layer; a z without one gets the next id in z order."""
    new = balls.select("z").distinct().join(layers, "z", "left_anti")
    top = layers.agg(F.coalesce(F.max("layer_id"), F.lit(0)).alias("_top"))
    rank = F.row_number().over(Window.orderBy("z"))  # layers of one stack: few
    new = new.crossJoin(F.broadcast(top)).withColumn("layer_id", (F.col("_top") + rank).cast("int")).select("z", "layer_id")
    return balls.join(layers.unionByName(new), "z")


# --- tables


def get_result(df: DataFrame, column: str, row: int, order: str) -> DataFrame:
    """A cell by column and row; -1 is the last row, an absent column gives null; also the number of rows.

    Running it fails where the table is empty or has no such row.
    """
    if row < -1:
        raise ValueError(f"row out of range: {row}")
    n, rows = df.agg(F.count("*").alias("n_rows")), F.col("n_rows")
    checked = F.when(rows == 0, F.raise_error(F.lit("the table is empty"))).when(rows <= row, F.raise_error(F.lit(f"row out of range: {row}"))).otherwise(rows)
    if column not in df.columns:
        return n.select(checked.alias("n_rows"), F.lit(None).cast("double").alias("value"))
    by = F.col(order).desc() if row < 0 else F.col(order)
    top = df.orderBy(by).select(F.col(column).alias("value")).offset(max(0, row)).limit(1)
    return n.join(F.broadcast(top), F.lit(True), "left").select(checked.alias("n_rows"), "value")  # a row each


def rank_displacement(df: DataFrame, group: str, index: str, position: Column) -> DataFrame:
    """Sum of |index - position| over the inner positions of each group's ranking."""
    placed = df.withColumn("_p", position).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    inner = F.when((F.col("_p") > 1) & (F.col("_p") < F.col("_n")), F.abs(F.col(index) - F.col("_p"))).otherwise(0)
    return placed.groupBy(group).agg(F.sum(inner).cast("long").alias("displacement"))
