"""Sources behind a caller's fetch function: paged listings, files by key, searches and model answers.

Tasks call the function, so a listing is one sequential task and keys are dealt over all of them. A call that fails is
tried again; what fails to the end gives a row with its error and no value, and no job stops for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..streaming.incremental import pending

#: Pages, and characters of them, that a task gathers before it passes them on.
ROWS, CHARS = 4096, 8 << 20


def retried(call: Callable[..., Any], tries: int = 5, interval: float = 0.0, most_wait: float = 30.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> Callable[..., Any]:
    """A function that calls at most once an interval (in its process) and, after an error, again after 1, 2, 4, ... seconds."""
    last = [float("-inf")]

    def run(*args: Any) -> Any:
        for k in range(tries):
            wait = interval - (clock() - last[0])
            if wait > 0:
                sleep(wait)
            try:
                return call(*args)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(min(most_wait, 2**k))
            finally:
                last[0] = clock()

    return run


def by_key(keys: DataFrame, fetch: Callable[[str], str | None], tries: int = 3, interval: float = 0.0) -> DataFrame:
    """(key, value, error) of the distinct keys: what fetch returns for each; a null key is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(fetch, tries, interval)
        for frame in frames:
            out = []
            for key in frame["key"]:
                try:
                    out.append((key, call(key), None))
                except Exception as e:
                    out.append((key, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["key", "value", "error"])

    own = keys.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
    return own.mapInPandas(run, "key string, value string, error string")


def pages(listings: DataFrame, fetch: Callable[[str, str | None], tuple[str | None, str | None]], most: int = 60, past: Callable[[str], bool] | None = None, tries: int = 3) -> DataFrame:
    """(listing, page, value, error) of each listing's pages in order.

    fetch(listing, token) returns a page and the token of the next one; the first token is null. A listing ends with an
    empty page, without a next token, after most pages, after an error, or after the first page for which past holds:
    newest-first feeds are left once they are past the session that is looked for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, out, size = retried(fetch, tries), [], 0
        for frame in frames:
            for listing in frame["listing"]:
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
                token, number = None, 0
                while number < most:
                    try:
                        value, token = call(listing, token)
                    except Exception as e:
                        out.append((listing, number, None, f"{type(e).__name__}: {e}"[:300]))
                        break
                    if not value:
                        break
                    out.append((listing, number, value, None))
                    size += len(value)
                    number += 1
                    if len(out) >= ROWS or size >= CHARS:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
                    if token is None or past is not None and past(value):
                        break
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["listing", "page", "value", "error"]
    return listings.select(F.col("listing").cast("string").alias("listing")).distinct().mapInPandas(run, "listing string, page int, value string, error string")


def synced(keys: DataFrame, ledger: DataFrame, fetch: Callable[[str], str | None], force: bool = False, most: int | None = None) -> DataFrame:
    """(wp, nr, value, error) of the sessions that the ledger lacks, newest first; the ledger grows by the rows without an error."""
    new = pending(keys, ledger, force, most).withColumn("key", F.concat_ws("/", "wp", "nr"))
    return new.join(by_key(new, fetch), "key", "left").select("wp", "nr", "value", "error")


def caption_text(value: Column) -> Column:
    """The lines of a caption file that are neither numbers, times nor empty, joined by spaces; empty for null."""
    blocks = F.filter(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), "\r", ""), r"\n\s*\n"), lambda b: F.contains(b, F.lit("-->")))
    lines = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(b, "\n"), lambda x: F.trim(x))))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.contains(x, F.lit("-->")) & ~x.rlike(r"^\d+$")), " ")


def captions(clips: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """clips (srt, ...) with text, that of their caption file; a file that can't be fetched gives an empty text."""
    found = by_key(clips.select(F.col("srt").alias("key")), fetch)
    return clips.join(found.select(F.col("key").alias("srt"), caption_text(F.col("value")).alias("text")), "srt", "left").na.fill("", ["text"])


def searched(claims: DataFrame, by: list[str], search: Callable[[str], list[tuple[str, str, str]]], stop: list[str] | None = None, most: int = 3) -> DataFrame:
    """(by, rank, titel, url, text) of the results of a search for each claim's terms; a search that fails has none.

    combined_evidence of the fact-checks puts several searches together."""
    asked = claims.select(*by, X.query_terms(F.col("text"), stop or []).alias("terms"))
    queries = asked.select("terms").where("terms != ''").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(search, 2)
        for frame in frames:
            out = []
            for terms in frame["terms"]:
                try:
                    out += [(terms, rank, *map(str, hit)) for rank, hit in enumerate(call(terms)[:most])]
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=["terms", "rank", "titel", "url", "text"])

    return asked.join(queries.mapInPandas(run, "terms string, rank int, titel string, url string, text string"), "terms").drop("terms")


def answered(prompts: DataFrame, chat: Callable[[str], str], prompt: str = "prompt", tries: int = 5, interval: float = 1.1) -> DataFrame:
    """prompts with answer, what a model says, and error; equal prompts are asked once."""
    found = by_key(prompts.select(F.col(prompt).alias("key")), chat, tries, interval)
    return prompts.join(found.select(F.col("key").alias(prompt), F.col("value").alias("answer"), "error"), prompt, "left")


def heard(files: DataFrame, model: Callable[[bytes], list[tuple[float, float, str, str]]], tries: int = 1) -> DataFrame:
    """(path, i, start, end, speaker, text, error) of audio files (path, content): what a speech or diarisation model hears.

    The model returns (start, end, speaker, text) of each piece, with an empty text from a diarisation alone and an empty
    speaker from a transcription alone. A file that fails has one row with its error, a silent one none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(model, tries)
        for frame in frames:
            for path, content in frame[["path", "content"]].itertuples(index=False):
                try:
                    out = [(path, i, float(a), float(b), who, said, None) for i, (a, b, who, said) in enumerate(call(bytes(content)))]
                except Exception as e:
                    out = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]
                yield pd.DataFrame(out, columns=["path", "i", "start", "end", "speaker", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, i int, start double, end double, speaker string, text string, error string")


def settings(env: dict[str, str], providers: dict[str, str] | None = None) -> dict[str, str]:
    """A model's settings from an environment: base_url and api_key (required), provider, chat_model, embed_model, embed_dim.

    Without LLM_PROVIDER the provider is the one of whose fragment the address holds, else custom."""
    base, key = env.get("LLM_BASE_URL", ""), env.get("LLM_API_KEY", "")
    if not base or not key:
        raise ValueError("LLM_BASE_URL and LLM_API_KEY must be set")
    near = next((name for name, part in (providers or {}).items() if part in base.lower()), "custom")
    return {"provider": env.get("LLM_PROVIDER") or near, "base_url": base, "api_key": key, "chat_model": env.get("LLM_CHAT_MODEL", ""), "embed_model": env.get("EMBEDDING_DEPLOYMENT", ""), "embed_dim": env.get("EMBEDDING_DIM", "3072")}
