"""Setting an index up, and checking that this machine can run it."""

from __future__ import annotations

import json
import os
import sys
import tempfile

import pyspark
from pyspark.sql import DataFrame, SparkSession

from passagelake import config
from passagelake.embedding import Embedder, HashingEmbedder, problem
from passagelake.operators import vectors as V


def union_excludes(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """All entries once, without regard to case, the first spelling kept."""
    seen: dict[str, str] = {}
    for x in (x for part in lists for x in part):
        seen.setdefault(x.lower(), x)
    return tuple(seen.values())


def templates_folder(root: str) -> str | None:
    """The folder of templates that the note app's settings name, in the spelling it has on disk."""
    try:
        with open(os.path.join(root, ".obsidian", "templates.json"), encoding="utf-8") as f:
            named = json.load(f).get("folder")
    except (OSError, ValueError, AttributeError):
        return None
    if not isinstance(named, str) or not named.strip("/"):
        return None
    found = ""
    for part in named.strip("/").split("/"):
        try:
            names = os.listdir(os.path.join(root, found))
        except OSError:
            return None
        hit = part if part in names else next((n for n in sorted(names) if n.lower() == part.lower()), None)
        if hit is None:
            return None
        found = f"{found}/{hit}" if found else hit
    return found


def init_index(root: str, base: str, exclude: tuple[str, ...] = ()) -> config.Config:
    """Check the folders and save the settings of a new index."""
    config.check_one_source(root)
    config.check_index_outside(base, root)
    path = os.path.join(base, "config.json")
    before = config.load(path)
    templates = templates_folder(root)
    made = config.replace(before, exclude=union_excludes(before.exclude, exclude, (templates,) if templates else ()))
    config.save(path, made)
    return made


def engine_self_test(spark: SparkSession) -> str | None:
    """What is wrong with the vector table: an id written again must replace, a deletion must be real, an equal vector must score 1."""
    first = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    again = spark.createDataFrame([("a", [0.0, 1.0])], "id string, vector array<double>")
    now = first.join(again, "id", "left_anti").unionByName(again).filter("id <> 'b'")
    q = spark.createDataFrame([(0, [0.0, 1.0])], "wording int, query array<double>")
    got = V.top_k(now, q, 5, "id").collect()
    if len(got) != 1 or got[0]["id"] != "a":
        return "replacing or deleting left rows behind"
    return None if got[0]["score"] >= 0.999 else "an equal vector does not score 1"


def doctor(spark: SparkSession, base: str, embedder: Embedder | None = None) -> DataFrame:
    """Readiness checks: name, state (ok, warn or fail) and what to do next."""
    embedder = embedder or HashingEmbedder()
    rows = [("spark", "ok" if int(pyspark.__version__.split(".")[0]) >= 4 else "fail", f"Spark {pyspark.__version__}"), ("python", "ok" if sys.version_info >= (3, 11) else "fail", sys.version.split()[0])]
    try:
        os.makedirs(base, exist_ok=True)
        with tempfile.TemporaryFile(dir=base):
            rows.append(("index-folder", "ok", "can be written"))
    except OSError:
        rows.append(("index-folder", "fail", "Choose a folder that can be written."))
    rows.append(("cloud-folder", "warn" if config.in_cloud_folder(base) else "ok", "An index in a cloud folder is slow." if config.in_cloud_folder(base) else "not in a cloud folder"))
    bad = problem(embedder.embed(["a question"])[0], embedder.dimensions)
    rows.append(("embedder", "fail" if bad else "ok", bad or embedder.name))
    wrong = engine_self_test(spark)
    rows.append(("engine", "fail" if wrong else "ok", wrong or "replaces, deletes and scores"))
    return spark.createDataFrame(rows, "name string, state string, next string")
