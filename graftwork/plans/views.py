"""Read-only views of a learning graph: inventory, summary, layout, events, DOT and report lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftwork.functions.text import clean, escape_quotes, shorten, tag_suffix
from graftwork.operators.acyclic import is_acyclic
from graftwork.rules import DEFAULT, RuleSet


def inventory(nodes: DataFrame) -> DataFrame:
    """What edge generators see of the nodes; seq is the order."""
    return nodes.select("seq", "id", "kind", "level", "text", "tags")


def inventory_json(nodes: DataFrame) -> DataFrame:
    return nodes.select("seq", F.to_json(F.struct("id", "kind", "level", "text", "tags"), {"ignoreNullFields": "false"}).alias("item"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total_nodes"), F.count_if(F.col("kind") == "Concept").alias("concepts"), F.count_if(F.col("kind") == "LearningOutcome").alias("learning_outcomes"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("total_edges"), F.count_if(F.col("relation") == "PrerequisiteFor").alias("prerequisite_edges"), F.count_if(F.col("relation") == "Supports").alias("supports_edges"))


def support_counts(edges: DataFrame) -> DataFrame:
    """Inbound supports of every node that has any."""
    return edges.where("relation = 'Supports'").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("supports"))


def top_outcomes(nodes: DataFrame, edges: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """The outcomes with the most supports; ties by text, then id. A top-k report."""
    outcomes = nodes.where("kind = 'LearningOutcome'").select("id", "text")
    counted = outcomes.join(support_counts(edges), "id", "left").select("id", "text", F.coalesce("supports", F.lit(0)).alias("supports"))
    return counted.orderBy(F.desc("supports"), "text", "id").limit(rules.top_outcomes)


def graph_summary(nodes: DataFrame, edges: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """One row; zeros, true and an empty list for an empty graph."""
    best = top_outcomes(nodes, edges, rules).agg(F.array_sort(F.collect_list(F.struct((-F.col("supports")).alias("minus"), "text", "id"))).alias("best"))
    ranked = best.select(F.transform("best", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), (-x["minus"]).alias("supports"))).alias("top_learning_outcomes"))
    dag = is_acyclic(edges.where("relation = 'PrerequisiteFor'"))
    one = lambda df: df.withColumn("row", F.lit(1))
    return reduce(lambda a, b: a.join(b, "row"), [one(x) for x in (node_counts(nodes), edge_counts(edges), dag, ranked)]).drop("row")


def summary_lines(top: DataFrame) -> DataFrame:
    """One line for each top outcome, as a summary announces them."""
    return top.select("id", F.format_string("LO %s (%d supports): %s", "id", "supports", "text").alias("message"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Average in- and out-degree over all nodes, to six places."""
    n = nodes.agg(F.count("*").alias("n")).withColumn("row", F.lit(1))
    ends = edges.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi").agg(F.count("*").alias("i")).withColumn("row", F.lit(1))
    starts = edges.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").agg(F.count("*").alias("o")).withColumn("row", F.lit(1))
    share = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) / F.col("n"), 6)).otherwise(0.0)
    return n.join(ends, "row").join(starts, "row").select(share("i").alias("avg_in_degree"), share("o").alias("avg_out_degree"))


def layout_order(nodes: DataFrame) -> DataFrame:
    """id, level, ord: arrival order within the level, from 0.

    Positions in a whole level can't be numbered in one task at scale: blocks of seq are counted first, and a row's number is its number in
    the block plus the rows of the blocks before."""
    rows = nodes.groupBy("id").agg(F.min_by(F.struct("level", "seq"), "seq").alias("first")).select("id", "first.level", "first.seq")
    rows = rows.withColumn("block", F.shiftright("seq", 12))
    own = Window.partitionBy("level", "block").orderBy("seq", "id")
    sizes = rows.groupBy("level", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("level").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    placed = rows.withColumn("k", F.row_number().over(own) - 1).join(before.select("level", "block", "before"), ["level", "block"])
    return placed.select("id", "level", (F.coalesce("before", F.lit(0)) + F.col("k")).cast("long").alias("ord"))


def layout_nodes(nodes: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """id, level, ord, label of the display, by level and order."""
    return layout_order(nodes).join(nodes.select("id", shorten(F.col("text"), rules.label_length).alias("label")), "id").orderBy("level", "ord", "id")


def layout_edges(edges: DataFrame, relation: str) -> DataFrame:
    """Distinct pairs of one relation, in order; (a, b) and (b, a) are two pairs."""
    return edges.where(F.col("relation") == relation).select("from_id", "to_id").distinct().orderBy("from_id", "to_id")


def node_events(admitted: DataFrame, sequence: Column) -> DataFrame:
    """One event for each node decision. Accepted: the cleaned text; rejected by one of the first rules: the raw text."""
    raw_text = F.col("clean_text") == ""
    return admitted.select(
        sequence.alias("event_seq"),
        F.when(F.col("accepted"), "NodeAccepted").otherwise("NodeRejected").alias("event_type"),
        F.col("assigned_id").alias("id"),
        F.when(F.col("accepted"), F.col("kind")).alias("kind"),
        F.when(F.col("accepted"), F.col("level")).alias("level"),
        F.when(F.col("accepted"), F.col("stored_tags")).alias("tags"),
        F.when(raw_text | F.col("reason").isin(DEFAULT.bad_granularity, DEFAULT.bad_level, DEFAULT.unknown_kind), F.coalesce("text", F.lit(""))).otherwise(F.col("clean_text")).alias("text"),
        "reason",
    )


def edge_events(admitted: DataFrame, sequence: Column) -> DataFrame:
    kept = lambda c: F.when(F.col("accepted"), F.col(c)).alias(c)
    return admitted.select(sequence.alias("event_seq"), F.when(F.col("accepted"), "EdgeAccepted").otherwise("EdgeRejected").alias("event_type"), "relation", kept("from_id"), kept("to_id"), kept("rationale"), "reason")


def event_lines(node_events_: DataFrame, edge_events_: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
    """event_seq, entity, level, message of the text log, one line for each event."""
    label = lambda c: shorten(F.col(c), rules.label_length)
    kept = F.col("event_type").isin("NodeAccepted", "EdgeAccepted")
    level = F.when(kept, "INFO").otherwise("WARN").alias("level")
    entity = lambda refused: F.when(kept, "graph/events").otherwise(refused).alias("entity")
    node = F.concat(F.lit("ACCEPT node "), F.col("kind"), F.lit(" lvl "), F.col("level").cast("string"), F.lit(" "), F.col("id"), F.lit(": "), label("text"), tag_suffix(F.col("tags")))
    no_node = F.concat(F.lit("REJECT node "), label("text"), F.lit(": "), F.col("reason"))
    edge = F.concat(F.lit("ACCEPT edge "), F.col("relation"), F.lit(" "), F.col("from_id"), F.lit(" -> "), F.col("to_id"), F.lit(": "), label("rationale"))
    no_edge = F.concat(F.lit("REJECT edge "), F.coalesce("relation", F.lit("?")), F.lit(": "), F.col("reason"))
    nodes = node_events_.select("event_seq", entity("graph/nodes_rejected"), level, F.when(kept, node).otherwise(no_node).alias("message"))
    return nodes.unionByName(edge_events_.select("event_seq", entity("graph/edges_rejected"), level, F.when(kept, edge).otherwise(no_edge).alias("message")))


def summary_event_lines(events: DataFrame) -> DataFrame:
    """The same for the lines that a summary announces."""
    return events.where("event_type = 'SummaryLine'").select("event_seq", F.lit("graph/summary").alias("entity"), F.lit("INFO").alias("level"), "message")


def dot_relation(c: Column) -> Column:
    """Relations in DOT are written in snake case."""
    return F.lower(F.regexp_replace(c, "(?<=[a-z])([A-Z])", "_$1"))


def dot_nodes(nodes: DataFrame) -> DataFrame:
    line = F.concat(F.lit('  "'), F.col("id"), F.lit('" [label="'), escape_quotes(clean(F.col("text"))), F.lit('"];'))
    return nodes.select("seq", line.alias("line"))


def dot_edges(nodes: DataFrame, edges: DataFrame, label_first: int | None = None) -> DataFrame:
    """Edges between known nodes; with label_first only the first so many (by seq) carry their rationale."""
    known = nodes.select("id")
    rows = edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    reason = escape_quotes(clean(F.coalesce("rationale", F.lit(""))))
    named = reason != ""
    if label_first is not None:
        first = rows.select("seq").orderBy("seq").limit(label_first).withColumn("first", F.lit(True))  # so many rows at most
        rows = rows.join(F.broadcast(first), "seq", "left")
        named = named & F.coalesce("first", F.lit(False))
    label = F.when(named, F.concat(dot_relation(F.col("relation")), F.lit(": "), reason)).otherwise(dot_relation(F.col("relation")))
    line = F.concat(F.lit('  "'), F.col("from_id"), F.lit('" -> "'), F.col("to_id"), F.lit('" [label="'), label, F.lit('"];'))
    return rows.select("seq", line.alias("line"))


def dot_lines(nodes: DataFrame, edges: DataFrame, name: str = "learning_graph") -> DataFrame:
    """section, seq, line of the whole file: header, nodes, edges, footer."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, 0, f"digraph {name} {{"), (3, 0, "}")], "section int, seq long, line string")
    parts = [frame, dot_nodes(nodes).withColumn("section", F.lit(1)), dot_edges(nodes, edges).withColumn("section", F.lit(2))]
    return reduce(DataFrame.unionByName, parts)


def write_dot(nodes: DataFrame, edges: DataFrame, path: str, name: str = "learning_graph") -> None:
    """One text file in a folder. Parts are sorted and written by all tasks; their bytes are then strung together, in order, by a stream on the driver."""
    spark = nodes.sparkSession
    dot_lines(nodes, edges, name).orderBy("section", "seq", "line").select("line").write.mode("overwrite").text(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    parts = sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    whole = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/.whole"), True)
    for part in parts:
        piece = fs.open(jvm.org.apache.hadoop.fs.Path(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, whole, conf, False)
        piece.close()
    whole.close()
    for part in parts:
        fs.delete(jvm.org.apache.hadoop.fs.Path(part), False)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/.whole"), jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000.txt"))


def report_lines(summary: DataFrame) -> DataFrame:
    """line_no, line of the console report for a graph_summary row."""
    fixed = F.array(
        F.format_string("Nodes: %d (concept=%d, learning_outcome=%d)", "total_nodes", "concepts", "learning_outcomes"),
        F.format_string("Edges: %d (prerequisite_for=%d, supports=%d)", "total_edges", "prerequisite_edges", "supports_edges"),
        F.concat(F.lit("Prerequisite DAG: "), F.when(F.col("prereq_dag_ok"), "OK").otherwise("Cycle detected")),
    )
    best = F.transform("top_learning_outcomes", lambda x: F.format_string("  %s (%d supports) - %s", x["id"], x["supports"], x["text"]))
    title = F.when(F.size(best) > 0, F.array(F.lit("Top learning outcomes by incoming supports:"))).otherwise(F.array().cast("array<string>"))
    return summary.select(F.posexplode(F.concat(fixed, title, best)).alias("line_no", "line"))


def reason_counts(decided: DataFrame) -> DataFrame:
    """rule, n: refused proposals by rule (the id that a reason names is left off)."""
    rule = F.regexp_replace("reason", "^(unknown (?:from|to)_id) .*$", "$1")
    return decided.where("NOT accepted").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_rejected"))
