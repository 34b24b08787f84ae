"""Command line: python -m tessella COMMAND --config FILE ... Results are printed as key=value lines; a failed check ends with status 1."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import checks
from .plans import dataset, tree
from .sources import scenes
from .sources.config import Config


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessella", description="Scene datasets on Spark")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: str) -> None:
        p = commands.add_parser(name, help=text)
        p.add_argument("--config", required=True, help="configuration (TOML)")
        for o in options:
            if o in ("scene-count", "samples-per-event", "scene-index"):
                p.add_argument(f"--{o}", type=int, default={"scene-count": 1, "samples-per-event": 24, "scene-index": 0}[o])
            else:
                p.add_argument(f"--{o}", required=True)

    command("generate", "write a dataset", "output", "scene-count", "samples-per-event")
    command("validate", "check a written dataset against its configuration", "output", "scene-count", "samples-per-event")
    command("export-split", "copy the scenes of a split", "generated-output", "output", "split")
    command("hash-config", "print the identity of a configuration")
    command("inspect-scene", "print the figures of a scene", "scene-index", "samples-per-event")
    command("preview", "write one scene's artifacts", "output", "scene-index", "samples-per-event")
    command("targets", "print the targets of a scene", "scene-index", "samples-per-event", "task-id")
    command("site-stats", "print the figures of the site graph")
    return out


def _line(values: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in values.items())


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    config = Config.load(a.config)
    if a.command == "hash-config":
        print(_line(config.identity()))
        return 0
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if getattr(a, "samples_per_event", 1) < 1:
        print("samples-per-event must be positive", file=sys.stderr)
        return 1
    if a.command == "generate":
        print("generation=ok", _line(tree.generate(spark, config, a.output, a.scene_count, a.samples_per_event)), sep="\n")
    elif a.command == "validate":
        found = tree.faults(spark, config, a.output, a.scene_count, a.samples_per_event).orderBy("path", "fault").limit(1000).collect()
        for r in found:
            print(f"path={r['path']}, fault={r['fault']}")
        print(f"validation={'failed' if found else 'ok'}")
        return 1 if found else 0
    elif a.command == "export-split":
        print("export=ok", _line(tree.exported(spark, a.generated_output, a.output, a.split)), sep="\n")
    elif a.command == "inspect-scene":
        figures, shapes = tree.inspected(spark, config, a.scene_index, a.samples_per_event)
        print("inspect-scene=ok", _line(figures), *map(_line, shapes), sep="\n")
    elif a.command == "preview":
        print("preview=ok", _line(tree.preview(spark, config, a.output, a.scene_index, a.samples_per_event)), sep="\n")
    elif a.command == "targets":
        t = checks.selected_tasks(dataset.targets(scenes.generate(spark, config, 1, a.scene_index), config, a.samples_per_event), "task_id", a.task_id, strict=True)
        print("targets=ok", _line(checks.target_report(t).first().asDict()), dataset.target_lines(t, 17).select(F.col("text")).first()[0], sep="\n")
    elif a.command == "site-stats":
        report, _, fault = tree.site(spark, config)
        print("site-stats=" + (fault or "ok"), _line(report), sep="\n")
        return 1 if fault else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
