"""Prompt and completion views, their files, and the manifest that names them by content."""

from __future__ import annotations

import datetime as dt
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import LABEL_NAMES, PROMPT
from ..sources import files, parts
from . import stats
from .curate import SPLITS, contamination, guarded, hash_of, with_labels

COLUMNS = ["cve_id", "cwe_id", "published", "description", "truncated", "prompt", "completion", "is_kev", "split"]


def label_lines(labels: list[str]) -> str:
    """The labels with their names, a line each; a label without a name is an error."""
    missing = [x for x in labels if x not in LABEL_NAMES]
    if missing:
        raise KeyError(f"labels without a name: {missing}")
    return "\n".join(f"- {x}: {LABEL_NAMES[x]}" for x in labels)


def prompt(description: Column, labels: list[str]) -> Column:
    before, after = PROMPT.format(label_lines=label_lines(labels), description="\0").split("\0")
    return F.concat(F.lit(before), description, F.lit(after))


def completion(label: Column) -> Column:
    return F.concat(F.lit('{"cwe_id": "'), label, F.lit('"}'))


def prompt_digest(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """One row, sha256: of the template and the labels in rank order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cwe_id"))), lambda x: x["cwe_id"]), "\n")
    return labels.agg(F.sha2(F.concat(F.lit(PROMPT + "\n"), listed), 256).alias("sha256"))


def export_rows(rows: DataFrame, labels: list[str], max_chars: int) -> DataFrame:
    text = F.substring("description_en", 1, max_chars)
    return rows.select(
        "cve_id", "cwe_id", "published", text.alias("description"), (F.length("description_en") > max_chars).alias("truncated"),
        prompt(text, labels).alias("prompt"), completion(F.col("cwe_id")).alias("completion"), "is_kev", "split",
    )


def over_budget(rows: DataFrame, tokens: str, max_length: int, max_new: int) -> DataFrame:
    """Rows whose prompt leaves no room for the answer."""
    return rows.where(F.col(tokens) > max_length - max_new)


def batched(rows: DataFrame, size: int, place: str = "ord") -> DataFrame:
    """The rows with batch and place in it, by their place from 0 in the whole; no shuffle."""
    if size < 1:
        raise ValueError("a batch has a row at least")
    return rows.withColumns({"batch": F.floor(F.col(place) / size), "place": F.col(place) % size})


def mask_problem(labels: Column, end: int, masked: int = -100) -> Column:
    """What is wrong with a completion mask: null for a masked prefix, then tokens without a gap, the last the end token."""
    first = F.array_position(F.transform(labels, lambda x: x != masked), True)
    tail = F.slice(labels, first.cast("int"), F.size(labels))
    return (
        F.when(F.coalesce(F.size(labels), F.lit(0)) == 0, "empty")
        .when(first == 0, "nothing_supervised")
        .when(first == 1, "no_masked_prefix")
        .when(~F.forall(tail, lambda x: x != masked), "gap")
        .when(F.element_at(labels, -1) != end, "no_end")
    )


def dataset_hash(digests: DataFrame) -> DataFrame:
    """One row, sha256 of the splits' digests one after another, train, val, test; digests has split and sha256."""
    place = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "sha256"))), lambda x: x["sha256"]), "")
    return digests.agg(F.sha2(joined, 256).alias("sha256"))


def _written(rows: DataFrame, folder: Path, name: str, order: list[str], in_parts: bool) -> dict[str, Any]:
    """Writes a split and returns its entry of the manifest."""
    if in_parts:
        done = parts.write_parts(rows, str(folder / name), order, COLUMNS)
        return {"path": name, "rows": done["rows"], "sha256": done["sha256"], "parts": len(done["parts"])}
    written, digest = files.write_jsonl(rows, folder / name, order, COLUMNS)
    return {"path": name, "rows": written, "sha256": digest}


def build(population: DataFrame, sampled: DataFrame, labels: list[str], folder: str | Path, settings: dict[str, Any], order: tuple[str, ...] = ("draw_rank", "cve_id"), in_parts: bool = False) -> dict[str, Any]:
    """Writes the splits' files and the manifest, once the guard has found no overlap; returns the manifest.

    A split is one file, streamed through the driver, or with in_parts a folder of parts that tasks write.
    """
    folder = Path(folder)
    have = [c for c in order if c in sampled.columns]
    out = export_rows(sampled, labels, settings["export"]["max_chars"])
    guarded(out.select("split", "cve_id", F.monotonically_increasing_id().alias("ord"), hash_of(out).alias("text_hash")))
    entries: dict[str, dict] = {}
    keyed = sampled.select(F.col("cve_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in have))
    ordered = out.join(keyed, F.col("cve_id") == F.col("_id"))
    for split in SPLITS:
        entries[split] = _written(ordered.where(F.col("split") == split), folder, split if in_parts else f"{split}.jsonl", [f"_{c}" for c in have], in_parts)
    manifest = {
        "version": 2,
        "created_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
        "files": entries,
        "counts": {s: e["rows"] for s, e in entries.items()},
        "populations": {r["split"]: r["count"] for r in population.groupBy("split").count().collect()},
        "labels": labels,
        "policy": settings["dedup"] | {"single_label_only": settings["filter"]["single_label_only"], "max_chars": settings["export"]["max_chars"], "seed": settings["seed"], "splits": settings["splits"]},
        "dataset_sha256": manifest_hash(entries),
    }
    files.write_json(manifest, folder / "manifest.json")
    return manifest


def manifest_hash(entries: dict[str, dict]) -> str:
    import hashlib

    return hashlib.sha256("".join(entries[s]["sha256"] for s in SPLITS).encode()).hexdigest()


def verify_files(spark: SparkSession, folder: str | Path, manifest: dict[str, Any]) -> list[str]:
    """What differs between the manifest and the files: digests and numbers of rows."""
    found = {r["name"]: r for r in files.file_digests(spark, str(folder)).where(F.col("name").endswith(".jsonl")).collect()}
    out = []
    for split, entry in manifest["files"].items():
        if "parts" in entry:
            path = str(Path(folder) / entry["path"])
            own = parts.read_manifest(path)
            if own is None:
                out.append(f"{split}: no file")
            elif own["sha256"] != entry["sha256"] or not (changed := parts.changed_parts(spark, path)).isEmpty():
                out.append(f"{split}: {'digest' if own['sha256'] != entry['sha256'] else ', '.join(sorted({r.problem for r in changed.collect()}))} differ")
            continue
        row = found.get(entry["path"])
        if row is None:
            out.append(f"{split}: no file")
        elif row["sha256"] != entry["sha256"] or row["rows"] != entry["rows"]:
            out.append(f"{split}: {'digest' if row['sha256'] != entry['sha256'] else 'rows'} differ")
    if manifest["dataset_sha256"] != manifest_hash(manifest["files"]):
        out.append("dataset digest differs")
    return out


def rebuild_split(spark: SparkSession, rows: DataFrame, split: str, folder: str | Path) -> dict[str, Any]:
    """Writes one split's file anew from export rows and updates the manifest; an error if another file has changed."""
    folder = Path(folder)
    manifest = files.read_json(folder / "manifest.json")
    changed = [p for p in verify_files(spark, folder, manifest) if not p.startswith((split, "dataset"))]
    if changed:
        raise ValueError(f"frozen files have changed: {changed}")
    schema = rows.select("split", "cve_id", "description").schema
    read = lambda e: parts.read_parts(spark, str(folder / e["path"]), schema) if "parts" in e else spark.read.schema(schema).json(str(folder / e["path"]))
    others = [read(manifest["files"][s]).select(*schema.names) for s in SPLITS if s != split and manifest["files"][s]["rows"]]
    all_ = rows.select("split", "cve_id", "description")
    for other in others:
        all_ = all_.unionByName(other)
    guarded(all_.select("split", "cve_id", F.monotonically_increasing_id().alias("ord"), hash_of(all_).alias("text_hash")))
    entry = manifest["files"][split]
    manifest["files"][split] = _written(rows, folder, entry["path"], ["published", "cve_id"], "parts" in entry)
    manifest["counts"][split] = manifest["files"][split]["rows"]
    manifest["dataset_sha256"] = manifest_hash(manifest["files"])
    manifest["changelog"] = [*manifest.get("changelog", []), f"rebuilt {split}"]
    files.write_json(manifest, folder / "manifest.json")
    return manifest


def markdown_table(rows: DataFrame, order: list[str] | None = None) -> str:
    """A small table as Markdown."""
    ordered = rows.orderBy(*order) if order else rows
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    shown = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x).replace("|", r"\|")
    return "\n".join([*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in ordered.collect())]) + "\n"


def report(sections: dict[str, DataFrame | dict], title: str = "Dataset report") -> tuple[dict[str, Any], str]:
    """Small tables and documents as one JSON value and one Markdown text."""
    value: dict[str, Any] = {}
    text = f"# {title}\n"
    for name, part in sections.items():
        if isinstance(part, dict):
            value[name] = part
            text += f"\n## {name}\n\n" + "\n".join(f"- {k}: {v}" for k, v in part.items()) + "\n"
        else:
            value[name] = [r.asDict(recursive=True) for r in part.collect()]
            text += f"\n## {name}\n\n" + markdown_table(part)
    return value, text


def dataset_report(rows: DataFrame, kept: DataFrame, exported: DataFrame, labels: DataFrame, tokens: Column | None = None) -> tuple[dict[str, Any], str]:
    """The dataset's report as JSON value and Markdown: funnel, coverage, exclusions, lengths, overlaps, classes, tiers.

    rows are the canonical rows with split and eligible, kept the population after dedup, exported what was sampled from
    it, labels the selected ones; tokens counts a description's tokens, words by default.
    """
    size = F.length("description_en")
    words = F.regexp_count("description_en", F.lit(r"\S+")) if tokens is None else tokens
    population = with_labels(rows.where("eligible AND split IS NOT NULL"), labels)
    sections: dict[str, DataFrame | dict] = {
        "Records": stats.funnel(rows),
        "Years": stats.per_year(rows).orderBy("year"),
        "Coverage": stats.coverage(rows, labels).orderBy("split"),
        "Excluded": stats.exclusions(rows, labels).orderBy("split"),
        "Characters": stats.percentiles(kept, size, "split").orderBy("split"),
        "Tokens": stats.token_summary(exported.withColumn("tokens", words), "tokens", "split").orderBy("split"),
        "Overlaps": contamination(population, exported),
        "Population by class": stats.class_distribution(kept).orderBy("split", "cwe_id"),
        "Exported by class": stats.class_distribution(exported).orderBy("split", "cwe_id"),
        "Tiers": stats.label_tiers(labels).orderBy("rank"),
    }
    return report(sections)
