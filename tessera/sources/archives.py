"""Batches for review as archives: pictures, what may be answered, and how."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The most pictures that an archive may hold: it is made in one piece.
MOST = 20
#: Names of what stands beside the pictures.
CATEGORIES, MANIFEST, TEMPLATE, PROMPT = "categories.json", "manifest.json", "answer-template.json", "prompt.txt"


def request(batch: str, names: list[str]) -> str:
    """What is asked of whoever labels the pictures."""
    example = {"batch_id": batch, "items": [{"file": name, "labels": []} for name in names[:2]]}
    return "\n".join([
        f"Label the {len(names)} pictures of this archive: {', '.join(names)}.",
        f"Use only the ids in {CATEGORIES}; a picture may have several, or none.",
        "Name only what can be seen; don't guess who somebody is, how old, or where.",
        "Every file stands in the answer exactly once.",
        f"Answer with JSON alone, in this form, and leave batch_id {batch} as it is:",
        json.dumps(example, ensure_ascii=False, indent=2),
    ]) + "\n"


def packed(items: DataFrame, categories: dict[str, str], embedding: str) -> DataFrame:
    """(id, archive) of batches' items (id, order, path, content): one zip a batch, without the paths.

    Pictures are named 01.jpg, 02.jpg and so on by order, ties by path; `file_names` tells which is which. The same items make the same bytes.
    A batch of more than MOST pictures raises; items without content are left out, as is a batch of none.
    """
    listed = json.dumps([{"id": k, "meaning": v} for k, v in sorted(categories.items())], ensure_ascii=False, indent=2)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > MOST:
            raise ValueError(f"batch {g['id'].iloc[0]} has {len(g)} pictures; {MOST} may be")
        g = g.sort_values(["order", "path"], kind="stable")
        batch, names = str(g["id"].iloc[0]), [f"{i:02d}.jpg" for i in range(1, len(g) + 1)]
        texts = {
            CATEGORIES: listed,
            MANIFEST: json.dumps({"batch_id": batch, "embedding_model": embedding, "items": [{"file": n} for n in names]}, indent=2),
            TEMPLATE: json.dumps({"batch_id": batch, "items": [{"file": n, "labels": []} for n in names]}, indent=2),
            PROMPT: request(batch, names),
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as archive:
            for name, content in [*zip(names, g["content"], strict=True), *texts.items()]:
                archive.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"id": [batch], "archive": [out.getvalue()]})

    return items.where("content IS NOT NULL AND id IS NOT NULL").select("id", "order", "path", "content").groupBy("id").applyInPandas(run, "id string, archive binary")


def unpacked(archives: DataFrame) -> DataFrame:
    """(id, file, content) of everything in archives (id, archive)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch["id"], batch["archive"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    names = archive.namelist()
                    yield pd.DataFrame({"id": key, "file": names, "content": [archive.read(n) for n in names]})

    return archives.select("id", "archive").mapInPandas(run, "id string, file string, content binary")
