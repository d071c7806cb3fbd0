"""Read models of notebooks: counts, trees, order, labels, logs, quotas, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import slug


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "n", where: Column | None = None) -> DataFrame:
    """``parents`` (id) with the number of children whose ``key`` names them, 0 where none does.

    Children are counted before the join, so only one row for each parent is joined.
    """
    counted = children.filter(where) if where is not None else children
    n = counted.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return parents.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """``parents`` (id) with the list of the children that ``key`` names, in the order of their other
    columns; an empty one where there are none."""
    fields = [c for c in children.columns if c != key]
    lists = children.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    none = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, "id", "left").withColumn(name, F.coalesce(name, none))


def renumbered(items: DataFrame, parents: list[str], order: list) -> DataFrame:
    """Places 0..n-1 among siblings; ties by id."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*parents).orderBy(*order, "id")) - 1)


def moved(ids: Column, item: Column, to: Column) -> Column:
    """A list with one item moved to an index, clamped to the list's ends."""
    rest = F.filter(ids, lambda x: x != item)
    at = F.greatest(F.lit(0), F.least(to, F.size(rest)))
    return F.concat(F.slice(rest, F.lit(1), at), F.array(item), F.slice(rest, at + 1, F.size(rest)))


def section_labels(sections: DataFrame) -> DataFrame:
    """Sections with ``label``: parent / title, or the title alone."""
    parent = sections.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    return sections.join(parent, "parent_id", "left").withColumn("label", F.concat_ws(" / ", "parent_title", "title"))


def annotation_kind(derivation: Column, color: Column) -> Column:
    return F.when(derivation == "EXPLAIN", "explain").when(derivation == "SIMPLIFY", "simplify").when(derivation == "SYNTHESIS", "assistant").when(color.isNotNull(), "highlight").otherwise("comment")


def block_kind(type_: Column, text: Column, html: Column) -> Column:
    level = F.regexp_extract(html, "^<h([1-3])", 1)
    return (
        F.when(type_ == "LIST", F.when(text.rlike(r"^\s*\d{1,3}[.)]\s"), "numbered").otherwise("list"))
        .when(type_ == "HEADING", F.when(F.coalesce(level, F.lit("")) != "", F.concat(F.lit("h"), level)).otherwise("h2"))
        .otherwise("paragraph")
    )


def latest(log: DataFrame, n: int, per: list[str] | None = None) -> DataFrame:
    """The n latest rows, ties by id, of all or of each key."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    if not per:
        return log.orderBy(*order).limit(n)
    return log.withColumn("rn", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def first_edits(edits: DataFrame) -> DataFrame:
    """The first edit of each block: block_id, before, created_at, id; aggregated before the shuffle."""
    first = F.min_by(F.struct("before", "created_at", "id"), F.struct("created_at", "id"))
    return edits.groupBy("block_id").agg(first.alias("f")).select("block_id", "f.before", "f.created_at", "f.id")


def trailing_counts(rows: DataFrame, per: list[str], seconds: int = 86_400) -> DataFrame:
    """Rows with the number of rows of their key in the window of time that ends with them.

    Each second with rows adds their number when it comes, and takes it off when it has left the
    window; the count is a running sum of these changes.  The sum is taken by stretches of the
    window's length: what is in the window as one begins is what came in the stretch before it, and
    in the last second of the one before that.  No task sees more than the seconds of a stretch.  A
    row without a time has no count.
    """
    at = F.unix_seconds(F.col("created_at").cast("timestamp"))
    counts = rows.groupBy(*per, at.alias("_at")).agg(F.count("*").alias("_n")).filter("_at IS NOT NULL")
    gone = counts.select(*per, (F.col("_at") + seconds + 1).alias("_at"), (-F.col("_n")).alias("_n"))
    changes = counts.withColumn("_came", F.lit(1)).unionByName(gone.withColumn("_came", F.lit(0))).groupBy(*per, "_at").agg(F.sum("_n").alias("_change"), F.max("_came").alias("_came"))
    stretch = F.floor(F.col("_at") / seconds)
    last = F.when(F.pmod(F.col("_at"), F.lit(seconds)) == seconds - 1, stretch + 2)
    carried = counts.select(*per, F.explode(F.array_compact(F.array(stretch + 1, last))).alias("_stretch"), "_n").groupBy(*per, "_stretch").agg(F.sum("_n").alias("_carried"))
    w = Window.partitionBy(*per, "_stretch").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    running = changes.withColumn("_stretch", stretch).withColumn("_sum", F.sum("_change").over(w)).filter("_came = 1")
    same = F.lit(True)
    for c in (*per, "_stretch"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    found = running.alias("r").join(carried.alias("c"), same, "left").select(*(F.col(f"r.{c}").alias(f"_{c}") for c in per), F.col("r._at").alias("__at"), (F.col("r._sum") + F.coalesce("c._carried", F.lit(0))).alias("trailing"))
    own = rows.withColumn("_at", at)
    same = F.col("_at") == F.col("__at")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(found, same, "left").select(*(F.col(c) for c in rows.columns), "trailing")


def within_quota(rows: DataFrame, per: list[str], most: int = 50, seconds: int = 86_400) -> DataFrame:
    """Rows with ``allowed``: fewer than ``most`` came before in the trailing window."""
    return trailing_counts(rows, per, seconds).withColumn("allowed", F.col("trailing") <= most)


def expired(rows: DataFrame, at: str, as_of: str, days: int, where: Column | None = None) -> DataFrame:
    cut = F.col(at) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return rows.filter(cut if where is None else cut & where)


def neighbours(blocks: DataFrame, reach: int = 2) -> DataFrame:
    """Blocks with the texts of up to ``reach`` blocks on either side, parted by blank lines."""
    w = Window.partitionBy("document_id").orderBy("ord")
    side = lambda a, b: F.array_join(F.collect_list("text").over(w.rowsBetween(a, b)), "\n\n")
    return blocks.withColumn("before", side(-reach, -1)).withColumn("after", side(1, reach))


def islands(rows: DataFrame, per: list[str], order: list, joins: Column) -> DataFrame:
    """Rows with ``run``: a new number wherever ``joins`` (with the row before) does not hold."""
    w = Window.partitionBy(*per).orderBy(*order)
    return rows.withColumn("run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def budget_fold(sizes: Column, budget: int) -> Column:
    """For each size in order whether it fits what is left; one that does not is passed over and
    later smaller ones may still fit."""
    step = lambda acc, n: F.when(acc["left"] - n <= 0, F.struct(acc["left"].alias("left"), F.concat(acc["kept"], F.array(F.lit(False))).alias("kept"))).otherwise(F.struct((acc["left"] - n).alias("left"), F.concat(acc["kept"], F.array(F.lit(True))).alias("kept")))
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<boolean>").alias("kept"))
    return F.aggregate(F.transform(sizes, lambda x: x.cast("bigint")), start, step, lambda acc: acc["kept"])


def cascade(root: DataFrame, levels: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What goes with rows that are deleted: for each (table, foreign key, key) in order the rows
    that name a row of the level before."""
    out, gone = [], root.select(F.col("id").alias("gone"))
    for rows, foreign, key in levels:
        out.append(rows.join(gone, rows[foreign] == gone["gone"], "left_semi"))
        gone = out[-1].select(F.col(key).alias("gone"))
    return out


def markdown_export(notebook: DataFrame, sections: DataFrame, notes: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Notebooks as Markdown: notebook_id, slug, content.

    Visible sections in order, their accepted notes, and footnotes numbered over the whole export,
    one for each source.
    """
    visible = sections.filter("not hidden").select(F.col("id").alias("section_id"), "notebook_id", F.col("title").alias("section"), F.col("ord").alias("section_ord"), F.when(F.col("parent_id").isNull(), "##").otherwise("###").alias("mark"))
    accepted = notes.filter("status = 'ACCEPTED'").select(F.col("id").alias("note_id"), "section_id", "content")
    cited = sources.join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("work")), "document_id").select("note_id", F.col("ord").alias("source_ord"), "quoted", "work")
    lines = visible.join(accepted, "section_id").join(cited, "note_id", "left")
    # sections are counted first, so that a notebook's lines need not meet in one task to be numbered
    ahead = Window.partitionBy("notebook_id").orderBy("section_ord", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    begin = lines.groupBy("notebook_id", "section_ord", "section_id").agg(F.count("source_ord").alias("k")).select("section_id", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("begin"))
    order = Window.partitionBy("section_id").orderBy("note_id", "source_ord", "quoted", "work").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.join(begin, "section_id").withColumn("n", F.col("begin") + F.count("source_ord").over(order))
    per_note = numbered.groupBy("notebook_id", "section_ord", "section_id", "section", "mark", "note_id", "content").agg(F.array_sort(F.collect_list(F.when(F.col("source_ord").isNotNull(), F.struct("n", "quoted", "work")))).alias("feet"))
    body = F.concat(F.col("content"), F.array_join(F.transform("feet", lambda f: F.concat(F.lit("[^"), f["n"].cast("string"), F.lit("]"))), ""))
    notes_out = per_note.select("notebook_id", "section_ord", "section_id", "section", "mark", "note_id", body.alias("body"), "feet")
    per_section = notes_out.groupBy("notebook_id", "section_ord", "section_id", "section", "mark").agg(F.array_sort(F.collect_list(F.struct("note_id", "body", "feet"))).alias("notes"))
    text = F.concat(F.col("mark"), F.lit(" "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("notes", lambda n: n["body"]), "\n\n"))
    foot = lambda f: F.concat(F.lit("[^"), f["n"].cast("string"), F.lit(']: "'), f["quoted"], F.lit('" — '), f["work"])
    whole = per_section.select("notebook_id", F.struct("section_ord", "section_id", text.alias("text"), F.flatten(F.transform("notes", lambda n: F.transform(n["feet"], foot))).alias("feet")).alias("s"))
    whole = whole.groupBy("notebook_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    parts = F.concat(F.transform("s", lambda s: s["text"]), F.array(F.array_join(F.flatten(F.transform("s", lambda s: s["feet"])), "\n")))
    heads = notebook.select(F.col("id").alias("notebook_id"), "title")
    return whole.join(heads, "notebook_id").select("notebook_id", slug(F.col("title")).alias("slug"), F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.array_join(parts, "\n\n")).alias("content"))
