"""The boundary to speech and translation models, and the operators around it.

Models are objects of the two protocols below, made on the executors by a factory; this repository has
only deterministic stubs.  What surrounds a call (prompts, batches, retries, fallbacks, the gate on a
review) is here and runs for each medium in order, since later calls see what was accepted before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.workers import ship
from ..settings import Settings

# Retry temperatures by attempt, the last one for all further attempts.
TEMPERATURES = (0.1, 0.3, 0.5)
BATCH, REVIEW_BATCH, ATTEMPTS = 10, 5, 3


class Transcriber(Protocol):
    def transcribe(self, samples, start: float, end: float, rescue: bool = False) -> list[dict]: ...
    def transcribe_specialist_batch(self, samples, clips: Sequence[tuple[float, float]]) -> list[list[dict]]: ...


class Translator(Protocol):
    def generate(self, instruction: str, max_tokens: int, attempt: int = 0) -> str: ...


_REGISTRY: dict[tuple[str, str], Callable[[Settings], object]] = {}


def register(name: str, factory: Callable[[Settings], object], kind: str = "translator") -> None:
    _REGISTRY[kind, name] = factory


def registered(name: str, kind: str = "translator") -> bool:
    return (kind, name) in _REGISTRY


def maker(name: str, settings: Settings, kind: str = "translator") -> Callable[[], object]:
    """A factory for executors: the backend is looked up here, on the driver, and goes with the task."""
    if not registered(name, kind):
        raise ValueError(f"unknown backend: {name}")
    make = _REGISTRY[kind, name]
    return lambda: make(settings)


def load(name: str, settings: Settings, kind: str = "translator") -> object:
    return maker(name, settings, kind)()


def temperature(attempt: int) -> float:
    return TEMPERATURES[min(attempt, len(TEMPERATURES) - 1)]


class EchoTranslator:
    """A stub: answers each numbered item with its text in angle marks."""

    def generate(self, instruction: str, max_tokens: int, attempt: int = 0) -> str:
        return "\n".join(f"[{n}] «{t}»" for n, t in re.findall(r"(?m)^\[(\d+)\] (.*)$", instruction.rpartition("Items:\n")[2]))


class LevelTranscriber:
    """A stub: hears one segment for each run of loud tenths of a second, and spells its mean level in syllables.

    ``rate`` is that of the samples.  At a second try it is a bit surer; the specialist hears the same.
    """

    SYLLABLES = "あいうえおかきくけこ"

    def __init__(self, rate: int = 16000, loud: float = 1000.0):
        self.rate, self.loud = rate, loud

    def transcribe(self, samples, start: float, end: float, rescue: bool = False) -> list[dict]:
        import numpy as np

        x = np.abs(np.asarray(samples[round(start * self.rate) : round(end * self.rate)], dtype=float))
        step = max(1, self.rate // 10)
        whole = len(x) // step * step
        means = [*x[:whole].reshape(-1, step).mean(axis=1).tolist(), *(float(t.mean()) for t in [x[whole:]] if len(t))]
        found, k = [], 0
        while k < len(means):
            n = k
            while n < len(means) and means[n] >= self.loud:
                n += 1
            if n > k:
                level = int(sum(means[k:n]) / (n - k))
                text = "".join(self.SYLLABLES[int(d)] for d in str(level))
                prob = -((level % 13) / 10) + (0.3 if rescue else 0.0)
                found.append({"start": start + k * step / self.rate, "end": start + n * step / self.rate, "text": text, "avg_logprob": min(0.0, prob), "no_speech_prob": (level % 7) / 10})
            k = max(n, k + 1)
        return found

    def transcribe_specialist_batch(self, samples, clips: Sequence[tuple[float, float]]) -> list[list[dict]]:
        return [self.transcribe(samples, a, b, rescue=True) for a, b in clips]


register("stub", lambda settings: EchoTranslator())
register("stub", lambda settings: LevelTranscriber(), kind="transcriber")


def parse_numbered(response: str, count: int) -> list[str] | None:
    """All of items 1 to ``count`` of a marked answer, or None.  The Column form is ``functions.text.parse_numbered``."""
    found: dict[int, str] = {}
    pieces = re.split(r"(?m)^\s*\[(\d+)\]\s*", response)
    for number, value in zip(map(int, pieces[1::2]), pieces[2::2]):
        if value.strip() and 1 <= number <= count:
            found[number] = value.strip()
    return [found[k] for k in sorted(found)] if len(found) == count else None


def _prompt(texts: Sequence[str], before: Sequence[str], after: Sequence[str], accepted: Sequence[tuple[str, str]], attempt: int) -> str:
    lines = [f"Before: {t}" for t in before] + [f"After: {t}" for t in after] + [f"Accepted: {s} => {t}" for s, t in accepted]
    again = f"\nAttempt {attempt + 1}: the last answer broke the format or script rules." if attempt else ""
    items = "\n".join(f"[{n}] {' '.join(t.split())}" for n, t in enumerate(texts, 1))
    return "Translate each item; answer with the same [number] marks." + again + "\nContext:\n" + ("\n".join(lines) or "(none)") + "\nItems:\n" + items


def translate_group(model: Translator, texts: Sequence[str], before=(), after=(), accepted=(), settings: Settings = Settings()) -> list[str]:
    """Up to three attempts for a batch, then item by item with the batch as context, then the fallback text."""
    left_over = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), settings.script.left_over) + "]")
    for attempt in range(ATTEMPTS):
        answer = model.generate(_prompt(texts, before, after, accepted, attempt), max(256, 100 * len(texts)), attempt=attempt)
        items = parse_numbered(answer, len(texts))
        if items is not None and not any(map(left_over.search, items)):
            return items
        if len(texts) == 1:
            bare = re.sub(r"^\s*\[1\]\s*", "", answer).strip()
            if bare and not left_over.search(bare):
                return [bare]
    if len(texts) == 1:
        return [settings.script.unclear]
    texts = list(texts)
    return [translate_group(model, [t], [*before, *texts[:k]], [*texts[k + 1 :], *after], accepted, settings)[0] for k, t in enumerate(texts)]


def translate_track(model: Translator, texts: Sequence[str], settings: Settings = Settings()) -> list[str]:
    """A medium's texts in batches of ten, each with the cues around it and the last accepted pairs."""
    done: list[str] = []
    n = settings.translation_context_cues
    for at in range(0, len(texts), BATCH):
        end = min(at + BATCH, len(texts))
        pairs = list(zip(texts[:at], done))[-n:] if n else []
        done += translate_group(model, texts[at:end], texts[max(0, at - n) : at], texts[end : end + n], pairs, settings)
    return done


def review_track(model: Translator, source: Sequence[str], candidates: Sequence[str], flagged: Sequence[bool], settings: Settings = Settings()) -> list[str]:
    """Flagged rows in fives; a safe replacement is taken and seen by later ones, a refused answer changes nothing."""
    inside = lambda c: re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), c) + "]").search
    left_over, ideograph = inside(settings.script.left_over), inside(settings.script.ideograph)
    now, rows = list(candidates), [k for k, f in enumerate(flagged) if f]
    if not settings.translation_review_enabled:
        return now
    for at in range(0, len(rows), REVIEW_BATCH):
        part = rows[at : at + REVIEW_BATCH]
        items = [f"{now[k]}" for k in part]
        around = [(source[k - 1] if k else "(start)", source[k + 1] if k + 1 < len(source) else "(end)") for k in part]
        prompt = _prompt(items, [f"{b} | {source[k]}" for k, (b, _) in zip(part, around)], [a for _, a in around], (), 0)
        answer = parse_numbered(model.generate(prompt, max(256, 120 * len(part)), attempt=1), len(part))
        if answer is None or any(map(left_over, answer)):
            continue
        for k, new in zip(part, answer):
            bare = new.strip()
            needs = left_over(source[k]) or ideograph(source[k])
            if bare and bare != source[k].strip() and (ideograph(bare) or not needs):
                now[k] = bare
    return now


def translate(cues: DataFrame, factory: Callable[[], Translator], media: str = "media_id", order: str = "idx", settings: Settings = Settings()) -> DataFrame:
    """``cues`` with candidate.  One medium is one task, as each batch depends on the one before."""
    ship(cues.sparkSession)
    schema = T.StructType([*cues.schema.fields, T.StructField("candidate", T.StringType())])

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(candidate=translate_track(factory(), pdf["text"].tolist(), settings))

    return cues.groupBy(media).applyInPandas(run, schema)


def review(pairs: DataFrame, factory: Callable[[], Translator], media: str = "media_id", order: str = "idx", settings: Settings = Settings()) -> DataFrame:
    """(text, candidate) with reviewed.  Reasons are found first, by Column functions; only flagged media reach a model."""
    from pyspark.sql import functions as F

    from ..functions.text import review_reasons

    ship(pairs.sparkSession)
    p = pairs.withColumn("flagged", F.size(review_reasons(F.col("text"), F.col("candidate"), settings)) > 0)
    schema = T.StructType([*p.schema.fields, T.StructField("reviewed", T.StringType())])

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(reviewed=review_track(factory(), pdf["text"].tolist(), pdf["candidate"].tolist(), pdf["flagged"].tolist(), settings))

    suspects = p.filter("flagged").select(media).distinct()
    asked = p.join(suspects, media, "left_semi").groupBy(media).applyInPandas(run, schema)
    return asked.unionByName(p.join(suspects, media, "left_anti").withColumn("reviewed", F.col("candidate")))
