"""The model that turns text into a record, behind an interface with an offline default."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[str], str]


def offline_model() -> Model:
    """A deterministic stand-in: the first line as title, the text itself, nothing else."""

    def reply(prompt: str) -> str:
        text = prompt.rpartition("Document content:\n")[2]
        return json.dumps({"document_info": {"title": text.strip().split("\n")[0][:200]}, "full_text_content": text}, ensure_ascii=False)

    return reply


def extract(prompts: DataFrame, make_model: Callable[[], Model] = offline_model, prompt_col: str = "prompt", delay: float = 0.0, skip: Column | None = None) -> DataFrame:
    """Adds ``response_text`` and ``call_error``; the model is made once in each partition and closed there if it can be.

    ``delay`` seconds pass between two calls of a partition; rows to ``skip`` are not called.
    """
    rows = prompts.withColumn("skip_", F.lit(False) if skip is None else skip)
    schema = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, called = make_model(), False
        try:
            for b in batches:
                replies, errors = [], []
                for p, off in zip(b[prompt_col], b["skip_"]):
                    reply, error = None, None
                    if not off:
                        if delay and called:
                            time.sleep(delay)
                        called = True
                        try:
                            reply = model(p)
                        except Exception as e:  # isolated by row
                            error = f"{type(e).__name__}: {e}"
                    replies.append(reply)
                    errors.append(error)
                yield b.drop(columns="skip_").assign(response_text=replies, call_error=errors)
        finally:
            getattr(model, "close", lambda: None)()

    return rows.mapInPandas(run, f"{schema},response_text string,call_error string")
