"""Command line: compress, info, extract, verify."""

from __future__ import annotations

import argparse
import json
import logging
import os
import time

from chunklake.session import local_session, tidy
from chunklake.sources import config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chunklake")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="mode", required=True)
    c = sub.add_parser("compress")
    c.add_argument("input", nargs="+")
    c.add_argument("-o", "--output", required=True)
    for name, kind in (("window", str), ("dictionary", str), ("dictionary_sample", str), ("level", int), ("hash_bits", int), ("normalisation", int), ("tune_timeout", float)):
        c.add_argument(f"--{name.replace('_', '-')}", type=kind)
    for name in ("auto_tune", "optimise_dictionary", "optical", "force"):
        c.add_argument(f"--{name.replace('_', '-')}", action="store_true", default=None)
    c.add_argument("--volumes", action="store_true", help="leave the volumes that tasks wrote beside the archive, instead of one file")
    i = sub.add_parser("info")
    i.add_argument("archive")
    i.add_argument("--json", action="store_true", default=None)
    for mode in ("extract", "verify"):
        e = sub.add_parser(mode)
        e.add_argument("archive")
        e.add_argument("--indices")
        if mode == "extract":
            e.add_argument("-o", "--output", required=True)
            e.add_argument("--force", action="store_true", default=None)
    return p


def clean_logs(folder: str, days: int) -> list[str]:
    """Removes log files older than `days` and returns their names."""
    old = time.time() - days * 86400
    gone = [n for n in sorted(os.listdir(folder)) if n.endswith(".log") and os.path.getmtime(os.path.join(folder, n)) < old]
    for n in gone:
        os.remove(os.path.join(folder, n))
    return gone


def main(argv: list[str] | None = None, spark=None) -> int:
    logging.basicConfig(level=logging.INFO)
    a = parser().parse_args(argv)
    base = config.load(a.config) if a.config else config.Settings()
    known = vars(config.Settings())
    s = config.merge(base, {k: v for k, v in vars(a).items() if k in known}).checked()
    spark = spark or local_session()
    from chunklake.plans import compress, discs, extract
    from chunklake.sources.archive import DISC, assemble, read_header

    images = a.mode != "compress" and read_header(a.archive)["format_id"] == DISC
    if a.mode == "compress" and s.optical:
        found, tracks, lists = discs.discs_of_folders(spark, a.input)
        print(json.dumps(discs.compress_discs(found, a.output, s, tracks, lists)))
        a.volumes or assemble(a.output)
    elif a.mode == "compress":
        print(json.dumps(compress.compress_files(spark, a.input, a.output, s)))
        a.volumes or assemble(a.output)
        tidy(spark)
    elif a.mode == "info":
        toc = extract.listing(spark, a.archive)
        if s.json:
            print("[" + ",\n".join(r.json for r in extract.listing_json(toc).orderBy("index").toLocalIterator()) + "]")
        else:
            for r in toc.orderBy("index").toLocalIterator():
                print(f"{r["index"]}\t{r.filename}\t{r.size}")
    elif a.mode == "extract" and images:
        os.makedirs(a.output, exist_ok=True)
        print(json.dumps({"discs": discs.extract_discs(spark, a.archive, a.output).count()}))
    elif a.mode == "extract":
        n = extract.extract(spark, a.archive, a.output, a.indices, s.force).count()
        print(json.dumps({"files": n}))
    else:
        checked = discs.verify_discs(spark, a.archive) if images else extract.verify(spark, a.archive, a.indices)
        bad = checked.filter("not ok").count()
        print(json.dumps({"damaged": bad}))
        tidy(spark)
        return int(bad > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
