"""Include graph: edges, reachability, and type aliases that can be seen from each file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import ensure_checkpoints
from .cparse import scan_typedefs


def include_specs(lines: DataFrame) -> DataFrame:
    """Include directives: path, line, spec, is_quoted."""
    spec = F.regexp_extract("text", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', 1)
    return lines.select("path", "line", spec.alias("spec"), F.regexp_like("text", F.lit(r'^\s*#\s*include\s*"')).alias("is_quoted")).filter("spec <> ''")


def plain_path(path):
    """A relative path without ``.`` and ``..`` steps; those that lead out of the root stay. Up to sixteen steps back."""
    out = F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), r"^(?:\./)+", "")
    for _ in range(16):
        out = F.regexp_replace(out, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return out


def unique_basenames(files: DataFrame) -> DataFrame:
    """Basenames that one file alone has."""
    base = F.element_at(F.split("path", "/"), -1)
    return files.select("path", base.alias("base")).distinct().groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select("base", "path")


def include_edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """src includes dst: beside the file, else from the root, else by a unique basename; angle includes from the root only. No loops.

    What a directive leads to depends on the folder it stands in, so each distinct one of a folder is looked up once, however many files have it. Lines and files are read once.
    """
    ensure_checkpoints(lines.sparkSession)
    files = files.select("path").distinct().checkpoint()
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    specs = include_specs(lines).select("path", folder.alias("folder"), "spec", "is_quoted").distinct().checkpoint()
    known = files.select(F.col("path").alias("known"))
    asked = specs.select("folder", "spec", "is_quoted").distinct()
    keyed = asked.withColumn("beside", plain_path(F.concat("folder", "spec"))).withColumn("plain", plain_path(F.col("spec"))).withColumn("base", F.element_at(F.split("plain", "/"), -1))
    a = keyed.join(known.withColumnRenamed("known", "k1"), keyed["beside"] == F.col("k1"), "left")
    b = a.join(known.withColumnRenamed("known", "k2"), F.col("plain") == F.col("k2"), "left")
    u = unique_basenames(files).select(F.col("base").alias("ubase"), F.col("path").alias("k3"))
    c = b.join(u, F.col("base") == F.col("ubase"), "left")
    dst = F.when(F.col("is_quoted"), F.coalesce("k1", "k2", "k3")).otherwise(F.col("k2"))
    told = c.select("folder", "spec", "is_quoted", dst.alias("dst")).filter("dst is not null")
    return specs.join(told, ["folder", "spec", "is_quoted"]).select(F.col("path").alias("src"), "dst").filter("dst <> src").distinct()


def include_closure(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(tu, visible): every file that a file reaches, itself included.

    Files that include the same files reach the same ones, so the rounds are over distinct sets of includes, and only over the edges of files that are included. They end when nothing new is found; each writes
    only what it found. A file then takes the rows of its set.
    """
    ensure_checkpoints(files.sparkSession)
    known = files.select(F.col("path").alias("tu")).distinct().checkpoint()
    # The set of a file is known by a digest of its sorted names.
    sets = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dsts")).withColumn("set", F.sha2(F.to_json("dsts"), 256)).checkpoint()
    found = [sets.dropDuplicates(["set"]).select("set", F.explode("dsts").alias("visible")).checkpoint()]
    onward = sets.join(found[0].select(F.col("visible").alias("src")).distinct(), "src", "left_semi").select("src", F.explode("dsts").alias("dst")).checkpoint()
    while True:
        step = found[-1].join(onward, found[-1]["visible"] == onward["src"]).select("set", F.col("dst").alias("visible")).distinct()
        frontier = step.join(reduce(DataFrame.unionByName, found), ["set", "visible"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        found.append(frontier)
    reached = known.join(sets.select(F.col("src").alias("tu"), "set"), "tu").join(reduce(DataFrame.unionByName, found), "set").filter("visible <> tu")
    return known.select("tu", F.col("tu").alias("visible")).unionByName(reached.select("tu", "visible"))


def typedef_lines(lines: DataFrame) -> DataFrame:
    """One-line type definitions: path, line, alias, and the words of the definition besides the alias."""
    body = F.regexp_extract("text", r"^\s*typedef\s+(.*?);", 1)
    alias = F.regexp_extract(body, r"(\w+)\s*(?:\[[^\]]*\]\s*)*$", 1)
    return lines.filter(F.regexp_like("text", F.lit(r"^\s*typedef\s"))).select("path", "line", alias.alias("alias"), F.array_except(words(body), F.array(alias)).alias("words")).filter("alias <> ''")


def time_aliases(typedefs: DataFrame, closure: DataFrame, seeds: tuple[str, ...] = ("time_t", "timespec", "timeval"), hops: int = 5, most: int = 64) -> DataFrame:
    """(tu, alias, hop): aliases whose definition, seen from the file, leads to a seed within ``hops``.

    A file's search ends after the hop in which it has ``most`` aliases or more.
    """
    ensure_checkpoints(typedefs.sparkSession)
    visible = closure.join(typedefs, closure["visible"] == typedefs["path"]).select("tu", "alias", F.explode("words").alias("word")).distinct().checkpoint()
    return _alias_rounds(visible, seeds, hops, most)


def _alias_rounds(visible: DataFrame, seeds: tuple[str, ...], hops: int, most: int) -> DataFrame:
    """Hops from the seeds over what each file sees (tu, alias, word)."""
    rounds = [visible.filter(F.col("word").isin(*seeds)).select("tu", "alias").distinct().withColumn("hop", F.lit(1)).checkpoint()]
    for hop in range(2, hops + 1):
        found = reduce(DataFrame.unionByName, rounds)
        open_tu = found.groupBy("tu").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < most).select("tu")
        step = visible.join(rounds[-1].select("tu", F.col("alias").alias("word")), ["tu", "word"]).select("tu", "alias").distinct().join(open_tu, "tu")
        frontier = step.join(found, ["tu", "alias"], "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)


def spread(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """``facts``: path and columns -> tu and the columns, for every file that reaches the path, itself included.

    Facts go backwards over the edges, each to a file once, so the work is in proportion to the edges of the files that see a fact and to the result; what no fact depends on is never
    walked. Cycles end as nothing new comes. Equal facts of several headers travel as one.
    """
    ensure_checkpoints(facts.sparkSession)
    names = [c for c in facts.columns if c != "path"]
    back = edges.select(F.col("dst").alias("tu"), F.col("src").alias("next")).distinct().checkpoint()
    found = [facts.select(F.col("path").alias("tu"), *names).distinct().checkpoint()]
    while True:
        step = found[-1].join(back, "tu").select(F.col("next").alias("tu"), *names).distinct()
        frontier = step.join(reduce(DataFrame.unionByName, found), ["tu", *names], "left_anti").checkpoint()
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(frontier)


def time_words(typedefs: DataFrame, seeds: tuple[str, ...], hops: int) -> DataFrame:
    """(path, alias, word): the definitions that can be part of a way of at most ``hops`` definitions from a seed, whichever files see them."""
    pairs = typedefs.select("path", "alias", F.explode("words").alias("word")).distinct().checkpoint()
    names = pairs.select("alias", "word").distinct().checkpoint()
    near = [names.filter(F.col("word").isin(*seeds)).select(F.col("alias").alias("word")).distinct().checkpoint()]
    for _ in range(2, hops):
        step = names.join(near[-1], "word").select(F.col("alias").alias("word")).distinct()
        fresh = step.join(reduce(DataFrame.unionByName, near), "word", "left_anti").checkpoint()
        if fresh.isEmpty():
            break
        near.append(fresh)
    every = reduce(DataFrame.unionByName, near).unionByName(typedefs.sparkSession.createDataFrame([(s,) for s in seeds], "word string")).distinct()
    return pairs.join(every, "word", "left_semi").select("path", "alias", "word")


def reached_aliases(typedefs: DataFrame, edges: DataFrame, seeds: tuple[str, ...] = ("time_t", "timespec", "timeval"), hops: int = 5, most: int = 64) -> DataFrame:
    """The rows of ``time_aliases``, without the closure of the include graph: only definitions on a way from a seed are told to the files that reach them."""
    ensure_checkpoints(typedefs.sparkSession)
    return _alias_rounds(spread(time_words(typedefs, seeds, hops), edges).checkpoint(), seeds, hops, most)


def reached_definitions(aliases: DataFrame, typedefs: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``alias_definitions``, without the closure."""
    wanted = typedefs.join(aliases.select("alias").distinct(), "alias", "left_semi").select("path", "alias", F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "text").alias("d"))
    return spread(wanted, edges).join(aliases.select("tu", "alias"), ["tu", "alias"]).groupBy("tu", "alias").agg(F.array_sort(F.collect_set("d")).alias("definitions"))


def flatten_aliases(scoped: DataFrame) -> DataFrame:
    """Per alias the files that see it and its shortest way to a seed."""
    return scoped.groupBy("alias").agg(F.countDistinct("tu").alias("n_files"), F.min("hop").alias("hop"))


def typedefs_of_files(files: DataFrame) -> DataFrame:
    """Type definitions of whole files, with the words besides the alias, as ``typedef_lines`` has them for lines."""
    found = scan_typedefs(files)
    return found.select("path", "line", "alias", "text", F.array_except(words(F.col("text")), F.array("alias", F.lit("typedef"))).alias("words"))


def alias_definitions(aliases: DataFrame, closure: DataFrame, typedefs: DataFrame) -> DataFrame:
    """The definitions of each alias that its file sees, as ``path:line: text`` in order: tu, alias, definitions."""
    seen = closure.join(typedefs, closure["visible"] == typedefs["path"]).select("tu", "alias", F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "text").alias("d"))
    return seen.join(aliases.select("tu", "alias"), ["tu", "alias"]).groupBy("tu", "alias").agg(F.array_sort(F.collect_set("d")).alias("definitions"))


def alias_payload(scoped: DataFrame) -> DataFrame:
    """Per file the aliases that it sees, sorted."""
    return scoped.groupBy(F.col("tu").alias("path")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def aliases_of(files: DataFrame, scoped: DataFrame) -> DataFrame:
    """The aliases that any of these files sees, for a prompt."""
    return scoped.join(files.select(F.col("path").alias("tu")).distinct(), "tu", "left_semi").select("alias").distinct()


def alias_rules(definitions: DataFrame) -> DataFrame:
    """A rule for each alias (tu, alias, definitions), scoped to the files that see it."""
    # A definition is told by every file that sees it; repeats go before the lists of an alias are made.
    symbol = F.col("alias").alias("symbol")
    told = definitions.select(symbol, F.explode("definitions").alias("d")).distinct().groupBy("symbol").agg(F.array_sort(F.collect_list("d")).alias("definitions"))
    rows = definitions.select(symbol, "tu").distinct().groupBy("symbol").agg(F.array_sort(F.collect_list("tu")).alias("scope_files")).join(told, "symbol", "left")
    rows = rows.withColumn("definitions", F.coalesce("definitions", F.array().cast("array<string>")))
    return rows.select(
        "symbol", F.lit("high").alias("risk"), F.lit("simple type").alias("category"), F.concat(F.lit("Typedef alias for time_t (discovered: "), F.size("definitions").cast("string"), F.lit(" definitions)")).alias("description"),
        F.lit(None).cast("string").alias("rule_id"), F.lit(False).alias("call_required"), "scope_files", F.lit(False).alias("type_use_only"), F.lit(True).alias("discovered"), F.lit("typedef").alias("discovery_type"), "definitions",
    )
