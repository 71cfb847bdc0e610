"""External programs and services: converter, model catalogue, memory probe."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def resolve_converter(explicit: str | None = None, variable: str = "DOCLING_BIN", name: str = "docling") -> str:
    """The converter's program: explicit, from the environment, from a near .venv, or the bare name."""
    if explicit:
        return explicit
    if os.environ.get(variable):
        return os.environ[variable]
    for up in (".", "..", "../.."):
        at = Path(up, ".venv", "bin", name)
        if at.is_file():
            return str(at)
    return name


def run_converter(path: str, content: bytes, program: str | None = None, to: str = "json", device: str = "auto") -> list[tuple[str, int | None]]:
    """Items of one file by the external converter. Raises where it fails; works in a folder of its own."""
    folder = Path(tempfile.mkdtemp())
    try:
        source, out = folder / Path(path).name, folder / "out"
        source.write_bytes(content)
        subprocess.run([resolve_converter(program), str(source), "--to", to, "--output", str(out), "--device", device], check=True, capture_output=True)
        made = sorted(out.iterdir())
        texts = json.loads(made[0].read_text()).get("texts", [])
        return [(t.get("text", ""), (t.get("prov") or [{}])[0].get("page_no")) for t in texts]
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _json(url: str, body: dict | None = None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=60) as r:
        return json.load(r)


def list_models(spark: SparkSession, host: str) -> DataFrame:
    """name and size of the models that a host has on disk."""
    return models_table(spark, _json(f"{host.rstrip('/')}/api/tags"))


def models_table(spark: SparkSession, reply: dict) -> DataFrame:
    return spark.createDataFrame([(m["name"], m.get("size", 0)) for m in reply.get("models", [])], "name string, size long")


def weight_bytes(models: DataFrame, model: str) -> int:
    """Size of a model; an unknown one raises."""
    row = models.where(models.name == model).first()
    if row is None:
        raise LookupError(f"no model {model!r}")
    return row["size"]


def model_metadata(host: str, model: str) -> str:
    """A model's metadata as JSON, for parse_model_info()."""
    return json.dumps(_json(f"{host.rstrip('/')}/api/show", {"model": model}))


def memory_line() -> str | None:
    """The first `used,total` line of the graphics card, or None where there is none."""
    try:
        out = subprocess.run(["nvidia-smi", "--query-gpu=memory.used,memory.total", "--format=csv,noheader,nounits"], capture_output=True, text=True, check=True)
        return out.stdout.splitlines()[0]
    except (OSError, subprocess.CalledProcessError, IndexError):
        return None


def resident_fraction(host: str, model: str) -> float | None:
    """The part of a loaded model that is in graphics memory, or None."""
    try:
        loaded = next(m for m in _json(f"{host.rstrip('/')}/api/ps")["models"] if m["name"] == model)
        return loaded["size_vram"] / loaded["size"]
    except (OSError, StopIteration, KeyError, ZeroDivisionError):
        return None
