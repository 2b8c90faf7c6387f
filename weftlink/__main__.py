"""Commands: ``link TRAIN TEST OUT`` links files in two stages that can be run apart, ``cache FOLDER`` makes a dataset's tables,
``score PRED TRUTH`` scores id lists, ``check MATCHES CANDIDATES SOURCE1`` validates them, ``verify A B`` compares files, and
``register FILE VERSION SCORE`` notes a run's public score.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import evaluate as E
from .plans import pipeline
from .plans.registry import Register
from .session import session
from .sources import tables as IO

L = "source1_entity_id"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="weftlink", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    places = {
        "link": ("train", "test", "out"),
        "cache": ("folder", "out"),
        "score": ("pred", "truth"),
        "check": ("matches", "candidates", "source1"),
        "verify": ("first", "second"),
        "register": ("file", "version", "score"),
    }
    for name, args in places.items():
        own = sub.add_parser(name)
        for a in args:
            own.add_argument(a)
    link = sub.choices["link"]
    link.add_argument("--kind", default="gbt", choices=("gbt", "logreg"))
    link.add_argument("--stage", default="all", choices=("fit", "apply", "all"), help="fit writes OUT/model, apply reads it")
    link.add_argument("--work", help="a folder for the stages' tables: a run that died goes on from there")
    return parser


def _lists(path: str) -> DataFrame:
    return IO.read_id_lists(session(), path).withColumnRenamed("id", L)


def _link(a: argparse.Namespace) -> DataFrame | None:
    cfg, spark, model = pipeline.Config(kind=a.kind), session(), f"{a.out}/model"
    if a.stage != "apply":
        pipeline.fit_files(spark, a.train, model, cfg, a.work)
    return pipeline.apply_files(spark, model, a.test, a.out, a.work) if a.stage != "fit" else None


def _score(a: argparse.Namespace) -> DataFrame:
    true = _lists(a.truth)
    flat = lambda df: df.select(L, F.explode("ids").alias("entity_id"))
    return E.score_pairs(flat(_lists(a.pred)), true.select(L), flat(true))


def _check(a: argparse.Namespace) -> DataFrame:
    s1 = IO.read_tsv(session(), a.source1).select(F.col("entity_id").alias(L))
    return IO.validate(_lists(a.matches), _lists(a.candidates), s1)


def _cache(a: argparse.Namespace) -> DataFrame:
    """The sources of both splits as tables; returns their sizes."""
    spark = session()
    folder = IO.find_dataset(spark, a.folder)
    store = IO.Store(spark, a.out, {"from": folder})
    rows = [(split, k, IO.load_sources(spark, folder, split, (k,), store=store).count()) for split in ("train", "test") for k in (1, 2, 3)]
    return spark.createDataFrame(rows, "split string, source int, rows long")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.what == "verify":
        same = IO.same_files({a.first: a.second})[a.first]
        print({"same": same})
        return int(not same)
    if a.what == "register":
        Register(a.file).set_public(a.version, float(a.score))
        return 0
    table = {"link": _link, "score": _score, "check": _check, "cache": _cache}[a.what](a)
    rows = table.collect() if table is not None else []
    for row in rows:
        print(row.asDict())
    return int(a.what in ("link", "check") and any(r["problems"] for r in rows if r["rule"] != "match outside candidates"))


if __name__ == "__main__":
    raise SystemExit(main())
