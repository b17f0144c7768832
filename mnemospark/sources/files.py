"""Files of a repository as a DataFrame: the walk's policy as one column expression.

Executors read the files; which of them are left out, and why, is decided by
``reason`` in the policy's order, so the skip report is the rejected side of
the same plan.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.shipping import ship

MOST_BYTES = 20_000_000
SNIFFED = 8192
CHUNKER_VERSION = 3

#: Folders that hold others' work or build output.
SKIPPED_FOLDERS = (
    "node_modules bower_components jspm_packages vendor Pods site-packages deps .venv venv .git .memory dist build _build "
    "target out obj Debug Release cmake-build-debug cmake-build-release __pycache__ .next .cache coverage htmlcov"
).split()
#: Dot folders that hold a project's own configuration.
OWN_DOT_FOLDERS = ".github .gitlab .husky .circleci .devcontainer .buildkite .claude".split()
#: Endings that are no text.
BINARY = (
    ".png .jpg .jpeg .gif .webp .bmp .ico .tiff .avif .mp3 .mp4 .wav .mov .avi .webm .ogg .flac .zip .gz .tar .rar .7z .bz2 "
    ".xz .jar .war .woff .woff2 .ttf .otf .eot .exe .dll .so .dylib .bin .o .a .class .wasm .pyc .pyo .node .db .sqlite "
    ".sqlite3 .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .psd .ai .sketch .fig .blend"
).split()
#: Endings and names of secrets and bookkeeping, never read unasked.
NEVER = (
    ".env .pem .key .pfx .p12 .keystore .jks .crt .cer .lock .log .map .tsbuildinfo .pid .pack .idx .min.js .min.css "
    ".bundle.js .chunk.js"
).split()
NEVER_NAMES = (
    ".env.local .env.production .env.development package-lock.json yarn.lock pnpm-lock.yaml bun.lockb poetry.lock Cargo.lock "
    "composer.lock Gemfile.lock go.sum id_rsa id_ed25519 .npmrc .netrc credentials settings.local.json"
).split()
#: Endings that are read only when the file is named.
NAMED_ONLY = ".svg .drawio .puml .plantuml .mermaid .mmd .excalidraw .csv .tsv .rtf".split()


def ignore_pattern(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression, for folders only, negated) of one ignore line."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line.removeprefix("!")
    folder = body.endswith("/")
    body = body.removesuffix("/")
    if not body:
        return None
    tokens = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    core = "".join(tokens.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]", body.removeprefix("/")))
    rooted = body.startswith("/") or "/" in body.removeprefix("/")
    return f"{'^' if rooted else '(?:^|/)'}{core}(?:/.*)?$", folder, negated


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last rule that matches a path (or, for folder rules, its folder) ignores it."""
    out = F.lit(False)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    for rule in filter(None, map(ignore_pattern, lines)):
        pattern, only_folders, negated = rule
        hit = folder.rlike(pattern) & path.contains("/") if only_folders else path.rlike(pattern)
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def _ends(path: Column, endings: list[str]) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(map(re.escape, endings)) + ")$")


def skip_reason(path: Column, length: Column, content: Column, ignore: list[str], most: int = MOST_BYTES) -> Column:
    """Why a file is left out, or null."""
    steps = F.split(path, "/")
    folders = F.slice(steps, 1, F.size(steps) - 1)
    name = F.element_at(steps, -1)
    hidden = F.exists(folders, lambda s: s.startswith(".") & ~s.isin(*OWN_DOT_FOLDERS))
    head = F.substring(content, 1, SNIFFED)
    return (
        F.when(hidden, "dot folder")
        .when(F.exists(folders, lambda s: s.isin(*SKIPPED_FOLDERS)), "skipped folder")
        .when(ignored(path, ignore), "ignored")
        .when(_ends(path, NAMED_ONLY), "only when named")
        .when(_ends(path, BINARY), "binary")
        .when(_ends(path, NEVER) | name.isin(*NEVER_NAMES), "secret or bookkeeping")
        .when(F.instr(F.hex(head), "00").isNotNull() & F.hex(head).rlike("^(?:..)*?00"), "not text")
        .when(length > most, "too large")
    )


def _listed(root: Path) -> list[str]:
    """Relative paths of all files but git's own.  Spark's listing leaves out names
    with a leading dot or underscore, which source trees are full of."""
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f != ".git")
        found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in sorted(names)]
    return found


def read_files(spark: SparkSession, root: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, content, length, reason, stamp) of all files under a folder that
    driver and executors see; names are listed here, contents read by the tasks."""
    base = Path(root.removeprefix("file://"))
    ignore = base / ".memignore"
    rules = ignore.read_text().splitlines() if ignore.exists() else []
    ship(spark)
    where = str(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                file = os.path.join(where, one.column(0)[0].as_py())
                size = os.path.getsize(file)
                with open(file, "rb") as f:
                    raw = f.read() if size <= most else f.read(SNIFFED)
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([raw], pa.binary()), pa.array([size], pa.int64())], names=["path", "raw", "length"])

    paths = spark.createDataFrame([(p,) for p in _listed(base)], "path string")
    raw = paths.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, raw binary, length long")
    text = F.when(F.col("reason").isNull(), F.decode("raw", "UTF-8"))
    return (
        raw.withColumn("reason", skip_reason(F.col("path"), F.col("length"), F.col("raw"), rules, most))
        .withColumn("content", text)
        .withColumn("stamp", F.concat(F.lit(f"{CHUNKER_VERSION}:"), F.sha2("raw", 256)))
        .drop("raw")
    )


def read_named(spark: SparkSession, root: str, name: str, most: int = MOST_BYTES) -> DataFrame:
    """The same row for one file that is named outright, under the root or the working
    folder: the walk's policy doesn't hold for it, but it must be text."""
    base = Path(root.removeprefix("file://"))
    for path in (base / name, Path(name)):
        if path.is_file():
            break
    else:
        raise FileNotFoundError(f"no file {name}")
    inside = path.resolve().is_relative_to(base.resolve())
    shown = str(path.resolve().relative_to(base.resolve()) if inside else path).replace(os.sep, "/")
    raw = path.read_bytes() if path.stat().st_size <= most else path.open("rb").read(SNIFFED)
    row = spark.createDataFrame([(shown, raw, path.stat().st_size)], "path string, raw binary, length long")
    head = F.hex(F.substring("raw", 1, F.lit(SNIFFED)))
    reason = F.when(head.rlike("^(?:..)*?00"), "not text").when(F.col("length") > most, "too large")
    return row.withColumn("reason", reason).select(
        "path", "length", "reason", F.when(F.col("reason").isNull(), F.decode("raw", "UTF-8")).alias("content"),
        F.concat(F.lit(f"{CHUNKER_VERSION}:"), F.sha2("raw", 256)).alias("stamp"),
    )


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) of a folder and all below it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def skip_report(files: DataFrame) -> DataFrame:
    out = files.where("reason is not null").groupBy("reason")
    return out.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def git_changes(root: str, mode: str = "working", base: str = "") -> list[str]:
    """Changed paths of a work tree: staged, working (with untracked), or compared with a base.

    A failing git is an error, never an empty list.
    """
    commands = {
        "staged": [["diff", "--cached", "--name-only", "--diff-filter=ACMR"]],
        "working": [["diff", "HEAD", "--name-only", "--diff-filter=ACMR"], ["ls-files", "--others", "--exclude-standard"]],
        "compare": [["diff", "--name-only", "--diff-filter=ACMR", f"{base}...HEAD"]],
    }[mode]
    found: set[str] = set()
    for c in commands:
        done = subprocess.run(["git", "-C", root, *c], capture_output=True, text=True, check=True)
        found.update(filter(None, done.stdout.splitlines()))
    return sorted(found)
