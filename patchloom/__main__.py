"""python -m patchloom generate|compare|benchmark|preview|key-preview|compare-backbones|compare-masks|ablation|train|predict|download|doctor ...; 0 if it went well, 1 if not, 130 if interrupted."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys


def cores() -> int:
    """Those this process may use: its affinity, and a quota of its control group."""
    n = len(os.sched_getaffinity(0))
    try:
        with open("/sys/fs/cgroup/cpu.max") as f:
            quota, period = f.read().split()
        return n if quota == "max" else max(1, min(n, int(quota) // int(period)))
    except (OSError, ValueError):
        return n


def memory() -> int:
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    try:
        with open("/sys/fs/cgroup/memory.max") as f:
            limit = f.read().strip()
        return total if limit == "max" else min(total, int(limit))
    except (OSError, ValueError):
        return total


def seam(text: str):
    """What `module:name` names: a model, a detector, a maker of masks."""
    module, _, name = text.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"{text} is not there: {e}") from e


def pairs(values: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in values)


STAND_IN = "patchloom.sources.images:HashBackbone"
LIMITED = ("compare", "preview", "key-preview", "compare-backbones", "compare-masks", "ablation")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="patchloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("generate", "compare", "benchmark", "preview", "key-preview", "compare-backbones", "compare-masks", "ablation", "train", "predict", "download", "doctor"):
        sub = commands.add_parser(name)
        sub.add_argument("--config")
        if name == "doctor":
            continue
        sub.add_argument("--dataset", required=True)
        sub.add_argument("--output", default="work")
        sub.add_argument("--limit", type=int, default=20 if name in LIMITED else 0 if name == "predict" else None)
        if name == "compare-backbones":
            sub.add_argument("--model", action="append", help="name=module:class of a model of two kinds of features, for each")
        elif name in ("generate", "compare", "benchmark", "key-preview", "compare-masks", "ablation"):
            sub.add_argument("--model", default=STAND_IN, help="module:class of a model")
        if name == "compare":
            sub.add_argument("--other", required=True, help="the second configuration")
        if name == "compare-masks":
            sub.add_argument("--annotator", required=True, help="module:function from decoded images to annotations")
        if name == "ablation":
            sub.add_argument("--variant", action="append", required=True, help="name=configuration, for each variant")
        if name == "train":
            sub.add_argument("--route", action="append", required=True, help="folder=split, for each split")
        if name == "predict":
            sub.add_argument("--detector", required=True, help="module:function from decoded images to detections")
            sub.add_argument("--confidence", type=float, default=0.25)
        if name == "download":
            sub.add_argument("--budget", type=int, default=1 << 62, help="bytes to transfer at most")
    return parser


def run(o: argparse.Namespace, settings) -> int:
    from pyspark.sql import SparkSession

    from patchloom import config
    from patchloom.operators import catalog
    from patchloom.plans import pipelines
    from patchloom.session import cut
    from patchloom.sources import archives, transfer

    spark = SparkSession.builder.appName(f"patchloom-{o.command}").getOrCreate()
    make = seam(o.model) if isinstance(getattr(o, "model", None), str) else None
    if o.command == "generate":
        report = pipelines.generate(spark, o.dataset, o.output, settings, make)
        print(json.dumps(report["runs"][0]))
        return int(report["status"] != "ok")
    if o.command == "benchmark":
        print(json.dumps(pipelines.benchmark(spark, o.dataset, settings, o.limit, make)))
    elif o.command == "compare":
        pipelines.compare(spark, o.dataset, settings, config.load(o.other), o.limit, make).show(o.limit, False)
    elif o.command == "compare-backbones":
        makes = {k: seam(v) for k, v in pairs(o.model or ["stand-in=patchloom.sources.images:HashDual"]).items()}
        pipelines.compare_backbones(spark, o.dataset, o.output, settings, makes, o.limit)[1].show(truncate=False)
    elif o.command == "compare-masks":
        pipelines.compare_masks(spark, o.dataset, settings, seam(o.annotator), o.limit, make)[1].show(truncate=False)
    elif o.command == "ablation":
        variants = {k: config.load(v) for k, v in pairs(o.variant).items()}
        subset = cut(catalog.deterministic_subset(catalog.scan(spark, o.dataset), o.limit, settings.pipeline.seed), "subset")
        features, sizes = (cut(x, "shared") for x in pipelines.features_of(spark, o.dataset, subset, settings, make))
        pipelines.ablation(spark, features, sizes, variants, make().grid).groupBy("variant").sum("n_boxes").show(truncate=False)
    elif o.command == "train":
        pipelines.prepare_training(spark, o.dataset, o.output, settings, f"{o.output}/training/{settings.train.run_name}", pairs(o.route)).show()
    elif o.command == "predict":
        print(json.dumps({"images": pipelines.predict(spark, o.dataset, f"{o.output}/predictions", seam(o.detector), o.confidence, o.limit)}))
    elif o.command == "download":
        index = archives.index(spark.createDataFrame([(o.dataset,)], "path STRING"))
        with archives.open_at(o.dataset) as f:
            total = f.seek(0, 2)
        path = o.dataset
        report = pipelines.download(spark, index, lambda: transfer.local(path), total, "local", f"{o.output}/images", o.output, o.budget, o.limit)
        print(json.dumps(report))
        return int(bool(report["errors"]))
    elif o.command == "preview":
        pipelines.preview(spark, o.dataset, o.output, settings, o.limit).show(o.limit, False)
    else:
        pipelines.key_preview(spark, o.dataset, settings, o.limit, make).write.mode("overwrite").parquet(f"{o.output}/key-preview")
    return 0


def main(args: list[str] | None = None) -> int:
    options = arguments().parse_args(args)
    from patchloom import config
    from patchloom.operators.planner import worker_limit

    try:
        settings = config.load(options.config) if options.config else config.Settings()
        if options.command == "doctor":
            print(json.dumps({"cores": cores(), "memory": memory(), "workers": worker_limit(cores(), cores(), memory())}))
            return 0
        return run(options, settings)
    except KeyboardInterrupt:
        return 130
    except (ValueError, RuntimeError, OSError) as e:
        print(f"patchloom: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
