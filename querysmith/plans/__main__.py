"""Command line: one subcommand for each step, and run for all of them from any step on."""

from __future__ import annotations

import argparse

from ..session import session
from ..sources import files
from . import steps


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="querysmith")
    names = parser.add_subparsers(dest="step", required=True)
    for name in [*steps.STEPS, "run"]:
        step = names.add_parser(name)
        step.add_argument("--config", help="JSON or YAML file")
        step.add_argument("--preset", help="file whose values come on top")
        step.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a single value on top")
        step.add_argument("--master")
        if name == "run":
            step.add_argument("--skip-to", choices=steps.WHOLE)
    a = parser.parse_args(argv)
    config = files.config(a.config, a.preset) if a.config else {}
    config |= dict(x.split("=", 1) for x in a.set)
    spark = session(master=a.master)
    if a.step == "run":
        steps.run(spark, config, a.skip_to)
    else:
        steps.STEPS[a.step](spark, config)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
