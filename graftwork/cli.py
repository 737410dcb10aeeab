"""Command line: ``python -m graftwork.cli run`` builds a demo graph, reports on it and may write it as DOT."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from graftwork.engine import LearningGraph
from graftwork.plans import views
from graftwork.rules import DEFAULT
from graftwork.scratch import Scratch
from graftwork.sources.chat import Chat, available, edge_source, node_source


@dataclass(frozen=True)
class RunConfig:
    topic: str = "program design"
    concepts: int = DEFAULT.default_concepts
    outcomes: int = DEFAULT.default_outcomes
    edges: int = DEFAULT.default_edges
    use_chat: bool = False
    export_dot: str | None = None
    path: str | None = None


def truth(text: str) -> bool:
    low = text.lower()
    if low in ("true", "1", "yes"):
        return True
    if low in ("false", "0", "no"):
        return False
    raise argparse.ArgumentTypeError(f"not a truth value: {text}")


def count(text: str) -> int:
    if not text.isdecimal():
        raise argparse.ArgumentTypeError(f"not a count: {text}")
    return int(text)


def parse_args(argv: list[str] | None = None) -> RunConfig:
    """Exits with status 1 on a bad command line."""
    parser = argparse.ArgumentParser(prog="graftwork", exit_on_error=True)
    parser.error = lambda message: parser.exit(1, f"{parser.format_usage()}{message}\n")  # type: ignore[method-assign]
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.error = parser.error  # type: ignore[method-assign]
    run.add_argument("--topic", default=RunConfig.topic)
    run.add_argument("--concepts", type=count, default=RunConfig.concepts)
    run.add_argument("--los", dest="outcomes", type=count, default=RunConfig.outcomes)
    run.add_argument("--edges", type=count, default=RunConfig.edges)
    run.add_argument("--use-llm", dest="use_chat", type=truth, default=False)
    run.add_argument("--export-dot", default=None)
    run.add_argument("--path", default=None, help="where the graph's tables go (by default the session's folder for intermediate tables, until the session ends)")
    values = vars(parser.parse_args(argv))
    values.pop("command")
    return RunConfig(**values)


def run(spark: SparkSession, config: RunConfig, chat: Chat | None = None) -> list[str]:
    """The whole pipeline; gives the report's lines."""
    graph = LearningGraph(spark, config.path or Scratch(spark, "graph").path())
    service = available(config.use_chat, os.environ)
    lines = []
    steps = (("Nodes", lambda: graph.add_nodes(node_source(spark, config.concepts, config.outcomes, chat, service))), ("Edges", lambda: graph.add_edges(edge_source(graph.inventory(), config.edges, chat, service))))
    for what, step in steps:
        n = views.decision_counts(step()).first()
        lines.append(f"{what} accepted: {n.n_accepted} / {n.n_accepted + n.n_rejected} (rejected {n.n_rejected})")
    lines += [r.line for r in views.report_lines(graph.summarize()).orderBy("line_no").collect()]
    if config.export_dot:
        graph.export_dot(config.export_dot)
        lines.append(f"DOT written to {config.export_dot}")
    return lines


def main(argv: list[str] | None = None) -> None:
    config = parse_args(argv)
    spark = SparkSession.builder.appName("graftwork").getOrCreate()
    print("\n".join(run(spark, config)))


if __name__ == "__main__":
    main()
