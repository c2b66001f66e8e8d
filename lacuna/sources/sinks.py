"""Sinks: sets of tables under a contract, and JSON beside them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

# What a benchmark and an evaluation consist of.
BENCHMARK = ("input_manifest", "selected_recordings", "learnable_gap_table", "exclusions", "coverage", "dataset_summary")
EVALUATION = ("lodo_gap_predictions", "lodo_summary", "lodo_tuning", "lodo_selected_method_counts_overall", "lodo_selected_method_counts_by_group")


def write_frame(frame: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Existing output is an error unless it may be overwritten."""
    w = frame.write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)


def write_json(path: str, document: dict) -> None:
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(document, indent=2, sort_keys=True, default=str) + "\n")


def write_set(tables: dict[str, DataFrame], folder: str, contract: tuple[str, ...], metadata: dict, fmt: str = "parquet", overwrite: bool = False) -> None:
    """All tables of a contract and metadata.json; missing or unknown tables are errors before anything is written."""
    if set(tables) != set(contract):
        raise ValueError(f"missing tables {sorted(set(contract) - set(tables))}, unknown tables {sorted(set(tables) - set(contract))}")
    if not overwrite and Path(folder).exists() and any(Path(folder).iterdir()):
        raise FileExistsError(folder)
    for name, frame in tables.items():
        write_frame(frame, f"{folder}/{name}", fmt, overwrite)
    write_json(f"{folder}/metadata.json", metadata)
    check_contract(folder, contract)


def check_contract(folder: str, contract: tuple[str, ...]) -> None:
    missing = [n for n in contract if not (Path(folder) / n / "_SUCCESS").exists()]
    if missing or not (Path(folder) / "metadata.json").exists():
        raise FileNotFoundError(f"{folder} lacks {missing or 'metadata.json'}")
