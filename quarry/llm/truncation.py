"""Problem 3: texts cut off before their end, and how often each source cuts.

Two kinds of evidence meet. *Length*: per source, and over the sources that have no limit there, a log-normal length distribution is
fitted by maximum likelihood, right-censored at candidate limits; the share of texts at a limit that the fitted density, scaled to the
lengths around, can't explain is the posterior of censoring there. It is the prior of every text of that length; elsewhere the prior is the
rate of cuts off the limits. A limit is a length that stands out from those around it, however large the collection; copies of a text count once.
*Ending*: what the text ends in, and how often the corpus ends a sentence after the same last two words. How often cut and whole texts
have each such ending isn't set but learned: the texts at the limits are cut for their lengths alone, whatever they end in, and show it. A text is cut if prior and
ending together make it likelier than not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import spread, written

#: Texts of one length and source that end openly, from which that length may be a limit, and the chance that one is found where none is.
AT_LIMIT, CHANCE = 2, 0.01
#: A limit has so many times the open endings that the lengths around it let expect: those within so many characters or this share of it.
STANDS_OUT, AROUND, SHARE_AROUND = 4.0, 20, 0.1
#: Texts of the fitted density that count beside those of the lengths around; rounds of finding limits and fitting without them.
BEFORE, LIMIT_ROUNDS = 4.0, 4
#: A last line is a closing line if it ends so many bodies, and this share of all bodies that end in a line of their own.
CLOSING_BODIES, CLOSING_SHARE = 2, 0.02
#: The rate of a sentence's end after two words that is taken as usual, and the most that a word nobody else uses may speak for an end.
BASE, UNKNOWN_ENDS = 0.08, 0.3
#: Where the learning of endings starts: how much likelier each is in a cut text; the weight of that start, in texts; the rate of cuts off the limits.
START = {"mark": 300.0, "open": 100.0, "line": 20.0, "list": 0.2, "closing": 0.4, "closes": 0.05, "furniture": 0.001, "stop": 0.001}
START_TEXTS, START_RATE = 4.0, 0.03
#: Endings that aren't learned: a mark comes after the cut, so no limit shows it; a stop isn't inside a sentence.
KEPT = ("mark", "stop")
#: Off the limits, cut texts may have an ending so many times as often as at them.
MORE = 2.0
#: Steps of the likelihood ratio of the last words, as powers of ten: half steps from -STEPS to STEPS.
STEPS = 2
ALL = "*"

_MARK = re.compile(r"(?:�|Ã|[\[(<&](?:[^\])>;\s]{0,4}|cut|more|continued|truncated)?|(?:…|\.\.\.)\s*\[?\+?\]?|\[(?:…|\.\.\.|cut|more|\+|truncated|continued)\]?|\((?:…|\.\.\.|cut|more|continued|truncated)\)?)$", re.I)
_STOP = re.compile(r"[.!?。！？:]['\"”’»)\]]*$")
_FURNITURE = re.compile(r"^\W*(?:(?:page|seite|página|pagina|p\.|s\.)\s*)?(?:\d{1,5}|[ivxlc]{1,7})(?:\s*(?:/|of|von|de|sur)\s*\d{1,5})?\W*$|^\W+$|^\(.{3,40}\)$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
_CAPTION = re.compile(r"(?:^|\| )\[\d+s\] ")
_ONE = r"[^\W_]+(?:['’][^\W_]+)*"
_WORD = re.compile(_ONE)
# where a sentence, a caption or a list item ends
_END = re.compile(r"[.!?]| \| |\n[\n-]")


def ending(body: str) -> tuple[str, str, str, str]:
    """(what the ending is, last line, the word before the last, the last word).

    What: blank, mark (leftover of a cut), stop (closing punctuation), furniture (page number, rule), list (of items or captions), closing
    (a short line of its own right under a finished one), line (a longer one) or open.
    """
    text = body.rstrip(" \t\r\n\f")
    if not text:
        return "blank", "", "", ""
    line = text[max(text.rfind("\n"), text.rfind("\f")) + 1 :].strip()
    words = _WORD.findall(text[-160:])
    if len(text) > 160 and text[-161:-160].isalnum() and len(words) > 1:
        words = words[1:]
    last = words[-1].lower() if words else ""
    previous = words[-2].lower() if len(words) > 1 else ""
    if _MARK.search(text[-24:]):
        what = "mark"
    elif _STOP.search(text[-8:]):
        what = "stop"
    elif _FURNITURE.match(line):
        what = "furniture"
    elif _ITEM.match(line) or (_CAPTION.search(text) and "\nTRANSCRIPT: " not in text):
        what = "list"
    else:
        before = text[: len(text) - len(line)].rstrip()
        alone = _STOP.search(before[-8:]) and text[: len(text) - len(line)].endswith("\n") and not before.endswith("\n") and text[len(before) : len(text) - len(line)].count("\n") == 1
        what = "closing" if alone and len(line) <= 20 and len(words) and len(line.split()) <= 4 else "line" if line != text.strip() and (_STOP.search(before[-8:]) or len(line) < 60 and text[len(text) - len(line) - 1] in "\n\f" and len(_WORD.findall(line)) < 4) else "open"
    return what, line, previous, last


def _endings(source: DataFrame, key: str, body: str) -> DataFrame:
    """(key, text, length, what, line, previous, last) of each body; ``text`` is a hash by which copies of a body are known."""
    kind = source.schema[key].dataType.simpleString()
    source = source.select(key, body, F.xxhash64(body).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [ending(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(t) for t in texts], pa.int32()), *(pa.array([r[i] for r in rows], pa.string()) for i in range(4))],
                names=[key, "text", "length", "what", "line", "previous", "last"],
            )

    return source.mapInArrow(run, f"`{key}` {kind}, text long, length int, what string, line string, previous string, last string")


def finals(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(previous, last, n, ended): over all distinct texts, how often two words (or, with previous null, one) occur in a row and how often a
    sentence, caption or list item ends after them. Counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: Counter = Counter()
            stops: Counter = Counter()
            for text in batch.column(0).to_pylist():
                text = text.rstrip().lower()
                words = _WORD.findall(text)
                if words and text.endswith(words[-1]):
                    words.pop()  # the text's own end is what is judged
                pairs.update(zip(["", *words], words, strict=False))
                for m in _END.finditer(text):
                    at = m.start()
                    if at and text[at - 1].isalnum():
                        two = _WORD.findall(text, max(0, at - 64), at)[-2:]
                        stops[two[0] if len(two) > 1 else "", two[-1]] += 1
            keys = list(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([pairs[k] for k in keys], pa.int64()), pa.array([stops[k] for k in keys], pa.int64())],
                names=["previous", "last", "n", "ended"],
            )

    parts = bodies.select(body).distinct().mapInArrow(run, "previous string, last string, n long, ended long")
    return parts.groupBy("previous", "last").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))


def _phi(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    erf = np.vectorize(math.erf, otypes=[float])
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi), (1 + erf(z / math.sqrt(2))) / 2


def fit_lengths(length: np.ndarray, n: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Maximum likelihood of (mu, sigma) of log length, by expectation maximisation; ``censored``: how many of ``n`` are lower bounds."""
    x = np.log(np.maximum(length, 1.0))
    exact = n - censored
    total = max(1.0, float(n.sum()))
    mu = float((n * x).sum() / total)
    sigma = max(0.05, math.sqrt(float((n * (x - mu) ** 2).sum() / total)))
    for _ in range(rounds):
        z = (x - mu) / sigma
        density, below = _phi(z)
        hazard = density / np.maximum(1 - below, 1e-9)
        one = mu + sigma * hazard
        two = mu * mu + sigma * sigma + sigma * (x + mu) * hazard
        first = float((exact * x + censored * one).sum() / total)
        second = float((exact * x * x + censored * two).sum() / total)
        new = max(0.05, math.sqrt(max(second - first * first, 1e-6)))
        done = abs(first - mu) + abs(new - sigma) < 1e-6
        mu, sigma = first, new
        if done:
            break
    return mu, sigma


def _tail(count: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """A bound on the chance that a Poisson number with this mean reaches ``count`` or more."""
    k = np.maximum(count, mean)
    return np.exp(k - mean - k * np.log(np.maximum(k, 1e-12) / np.maximum(mean, 1e-12)))


def _near(length: np.ndarray, x: np.ndarray, density: np.ndarray, out: np.ndarray) -> np.ndarray:
    """What is expected of ``x`` at each length: the density there, scaled to what the lengths around it hold. Neither the length itself
    counts nor those marked ``out``; a few texts of the density stand for what is known before."""
    wide = np.maximum(AROUND, SHARE_AROUND * length)
    order = np.argsort(length, kind="stable")
    at = length[order]
    lo, hi = np.searchsorted(at, length - wide, "left"), np.searchsorted(at, length + wide, "right")
    own_lo, own_hi = np.searchsorted(at, length, "left"), np.searchsorted(at, length, "right")
    held = np.concatenate([[0.0], np.cumsum(np.where(out, 0.0, x)[order])])
    seen = held[hi] - held[lo] - (held[own_hi] - held[own_lo])
    # the density's own number in the window: lengths without any text count, those left out don't
    slots = np.concatenate([[0.0], np.cumsum(np.where(out, 1.0, 0.0)[order])])
    gone = slots[hi] - slots[lo] - (slots[own_hi] - slots[own_lo])
    room = np.maximum(1.0, np.floor(length + wide) - np.maximum(np.ceil(length - wide), 1.0) - gone)
    return density * (seen + BEFORE) / (density * room + BEFORE)


def limits(group: pd.DataFrame) -> pd.DataFrame:
    """From the lengths of one source (length, n, open): its candidate limits with their posterior of censoring. A limit stands out from the
    lengths around it: more open endings than chance puts at any of the source's lengths, all of them tried, and so many that they
    explain less than 1 / STANDS_OUT of it. That holds at any size of the collection, as what is expected grows with it."""
    length, n, open_ = (group[c].to_numpy(float) for c in ("length", "n", "open"))
    first = np.zeros(len(length), bool)
    for _ in range(LIMIT_ROUNDS):
        mu, sigma = fit_lengths(length, n, np.where(first, open_, 0.0))
        z = (np.log(np.maximum(length, 1.0)) - mu) / sigma
        density = np.maximum(n.sum() * np.exp(-z * z / 2) / (np.maximum(length, 1.0) * sigma * math.sqrt(2 * math.pi)), 0.02)
        expected = _near(length, n, density, first)
        rest = ~first
        share = max(1e-3, float(open_[rest].sum()) / max(1.0, float(n[rest].sum())))
        opens = _near(length, open_, density * share, first)
        most = STANDS_OUT * np.maximum(opens, share * (n - open_))  # where whole texts have a length often, open ones do too
        found = (open_ >= AT_LIMIT) & (open_ > most) & (_tail(open_, opens) * len(length) < CHANCE)
        if (found == first).all():
            break
        first = found
    posterior = np.clip(1 - expected / np.maximum(n, 1), 0.0, 0.999)
    out = pd.DataFrame({"source": group["source"].iloc[0], "limit": length.astype("int32"), "posterior": posterior, "mu": mu, "sigma": sigma})
    return out[first]


def _learned(names: list[str], start: np.ndarray, where: np.ndarray, known: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """(the log likelihood ratio of each ending, cut to whole; the rate of cuts off the limits), from where the learning starts and the rows
    (ending, limit posterior or nan, texts)."""
    kept = np.array([w in KEPT for w in names])
    off = np.isnan(known)
    if off.all():  # no limit, nothing to learn from
        return np.log(start), START_RATE
    there = lambda x: np.bincount(where, x, len(names))
    share = there(n) / n.sum()
    begin_cut, begin_whole = START_TEXTS * share * start / (share * start).sum(), START_TEXTS * share
    unlimited = there(np.where(off, n, 0.0))
    prior = np.clip(np.nan_to_num(known), 1e-6, 1 - 1e-6)
    ratio, rate = np.log(start), START_RATE
    for _ in range(rounds):
        cut = np.where(off, 0.0, n / (1 + np.exp(-(np.log(prior / (1 - prior)) + ratio[where]))))
        seen = there(cut)
        of_cut = (seen + begin_cut) / (seen.sum() + START_TEXTS)
        # off the limits: the least ratio of texts to cut ones, by their greater half
        order = np.argsort(unlimited / of_cut)
        order = order[~kept[order]]
        half = order[: 1 + int(np.searchsorted(np.cumsum(of_cut[order]), 0.5 * of_cut[order].sum()))]
        held = unlimited[half].sum() / max(1e-12, of_cut[half].sum())
        held = (seen[half].sum() * held + START_TEXTS * START_RATE * unlimited.sum()) / (seen[half].sum() + START_TEXTS)
        explained = MORE * held * of_cut
        noise = 2 * np.sqrt(unlimited + explained * MORE * held / max(1.0, seen.sum()))
        whole = np.maximum(0.0, unlimited - explained - noise) + there(np.where(off, 0.0, n - cut))
        of_whole = (whole + begin_whole) / (whole.sum() + START_TEXTS)
        before, ratio = ratio, np.where(kept, np.log(start), np.log(of_cut) - np.log(of_whole))
        rate = float(np.clip(held / max(1.0, unlimited.sum()), 1e-4, 0.5))
        if np.abs(ratio - before).max() < 1e-4:
            break
    return ratio, rate


def learn_endings(cells: list[tuple[str, int, float | None, int]]) -> tuple[dict[tuple[str, int], float], float]:
    """From (ending, step, limit posterior or None off the limits, texts): (the log likelihood ratio of each ending and step, cut to whole; the
    rate of cuts off the limits). Endings are learned first, then their steps, which start from the
    ratio of the ending and half that of the step, as words that follow each other aren't independent.

    Cut texts are seen at the limits, whole and cut ones mixed off them. Of the mixture cut texts are given as great a share as it can hold: that
    of the endings most of which are cut. What an ending has beyond MORE times that share, and two deviations, is whole. KEPT endings
    keep their start.
    """
    if not cells:
        return {}, START_RATE
    known = np.array([np.nan if c[2] is None else c[2] for c in cells])
    n = np.array([c[3] for c in cells], float)
    whats = sorted({c[0] for c in cells})
    ratio, _ = _learned(whats, np.array([START[w] for w in whats]), np.array([whats.index(c[0]) for c in cells]), known, n)
    of = dict(zip(whats, ratio.tolist(), strict=True))
    names = sorted({(c[0], c[1]) for c in cells})
    start = np.exp([np.clip(of[w] + math.log(10) * k / 4, -12, 12) for w, k in names])
    ratio, rate = _learned([w for w, _ in names], start, np.array([names.index((c[0], c[1])) for c in cells]), known, n)
    return dict(zip(names, ratio.tolist(), strict=True)), rate


def first_folders(files: DataFrame) -> DataFrame:
    """(hash, source): the first folder of the path of each asset's file with the smallest id; a file outside any folder has source ''."""
    return (
        files.where(F.col("hash").isNotNull())
        .groupBy("hash")
        .agg(F.min(F.struct("id", "path")).alias("f"))
        .select("hash", F.when(F.col("f.path").contains("/"), F.regexp_extract("f.path", r"^/*([^/]*)/", 1)).otherwise("").alias("source"))
    )


def _rate(n: Column, ended: Column, base: float) -> Column:
    return (F.coalesce(ended, F.lit(0)) + 4 * base) / (F.coalesce(n, F.lit(0)) + 4.0)


def truncated(assets: DataFrame, files: DataFrame, key: str = "hash", body: str = "body") -> DataFrame:
    """(hash, source, length, what, cut_limit, length_posterior, probability, cut) of every asset with a body that isn't blank.

    ``length_posterior`` is the posterior of censoring by the length alone, at a limit of the source or of the other sources together, else the
    learned rate of cuts off the limits; ``probability`` adds the ending. An asset without a file has source null and is judged like one
    outside any folder. A null or blank body has no row. Repeated hashes are judged each.
    """
    spark = assets.sparkSession
    bodies = spread(assets.where(F.col(body).isNotNull() & (F.length(F.trim(F.col(body))) > 0)).select(key, body))
    ends = _endings(bodies, key, body).where("what <> 'blank'")
    sources = first_folders(files).withColumnRenamed("hash", "_hash")
    ends = written(ends.join(sources, F.col(key) == F.col("_hash"), "left").drop("_hash"), "endings")
    open_ = F.col("what").isin("open", "line", "mark").cast("int")
    folder = F.coalesce("source", F.lit(""))
    # copies of a text are one piece of evidence, or each cut text that is copied would look like a limit
    distinct = ends.select(folder.alias("source"), "length", "text", open_.alias("open")).distinct()
    per = written(distinct.groupBy("source", "length").agg(F.count("*").alias("n"), F.sum("open").alias("open")), "lengths")
    shape = "source string, limit int, posterior double, mu double, sigma double"
    own = written(per.groupBy("source").applyInPandas(limits, shape), "limits").select(F.col("source").alias("_s"), F.col("limit").alias("_l"), F.col("posterior").alias("own"))
    others = per.join(own, (F.col("source") == F.col("_s")) & (F.col("length") == F.col("_l")), "left_anti")
    pooled = others.groupBy("length").agg(F.sum("n").alias("n"), F.sum("open").alias("open")).select(F.lit(ALL).alias("source"), "length", "n", "open")
    pooled = written(pooled.groupBy("source").applyInPandas(limits, shape), "pooled").select(F.col("limit").alias("length"), F.col("posterior").alias("pooled"))
    alone = ends.where("what in ('line', 'closing')").select("text", "line").distinct()
    closing = alone.groupBy("line").agg(F.count("*").alias("closers")).crossJoin(F.broadcast(alone.agg(F.count("*").alias("lines"))))
    counts = written(finals(bodies, body), "finals")
    words = counts.groupBy("last").agg(F.sum("n").alias("n1"), F.sum("ended").alias("e1"))
    before = counts.groupBy("previous").agg(F.sum("n").alias("n0"), F.sum("ended").alias("e0"))
    judged = ends.join(own, (folder == F.col("_s")) & (F.col("length") == F.col("_l")), "left").drop("_s", "_l").join(pooled, "length", "left").withColumn("known", F.coalesce("own", "pooled"))
    columns = [key, "text", "source", "length", "what", "known", "ending", "step"]
    settled = judged.where(F.col("what").isin("stop", "furniture", "mark")).withColumns({"ending": F.col("what"), "step": F.lit(0)}).select(*columns)
    worded = (
        judged.where(F.col("what").isin("open", "line", "closing", "list"))
        .join(closing, "line", "left").join(counts, ["previous", "last"], "left").join(words, "last", "left").join(before, "previous", "left")
    )
    backed = F.when(F.coalesce("n1", F.lit(0)) >= 3, _rate(F.col("n1"), F.col("e1"), BASE)).otherwise(F.least(_rate(F.col("n0"), F.col("e0"), BASE), F.lit(UNKNOWN_ENDS)))
    rate = F.when(F.coalesce("n", F.lit(0)) >= 3, _rate(F.col("n"), F.col("ended"), BASE)).otherwise(backed)
    step = F.least(F.greatest(F.round(2 * F.log10(((1 - rate) / (1 - BASE)) / (rate / BASE))), F.lit(-2 * STEPS)), F.lit(2 * STEPS)).cast("int")
    closes = F.col("what").isin("line", "closing") & (F.coalesce("closers", F.lit(0)) >= F.greatest(F.lit(CLOSING_BODIES), CLOSING_SHARE * F.col("lines")))
    worded = worded.withColumns({"ending": F.when(closes, "closes").otherwise(F.col("what")), "step": step}).select(*columns)
    rows = written(settled.unionByName(worded), "judged")
    # a table of at most 8 endings, 9 steps and 1001 posteriors
    once = rows.select("text", "ending", "step", F.round("known", 3).alias("known")).distinct()
    cells = once.groupBy("ending", "step", "known").agg(F.count("*").alias("texts")).collect()
    ratio, off = learn_endings([(r["ending"], r["step"], r["known"], r["texts"]) for r in cells])
    ratios = spark.createDataFrame([(e, k, v) for (e, k), v in ratio.items()], "ending string, step int, ratio double")
    prior = F.greatest(F.coalesce("known", F.lit(off)), F.lit(off))  # a text of a limit's length may be cut off it as any other
    bounded = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    probability = 1 / (1 + F.exp(-(F.log(bounded / (1 - bounded)) + F.col("ratio"))))
    return rows.join(F.broadcast(ratios), ["ending", "step"]).select(
        key, "source", "length", "what", F.when(F.col("known").isNotNull(), F.col("length")).alias("cut_limit"), prior.alias("length_posterior"), probability.alias("probability"), (probability > 0.5).alias("cut")
    )


def cut_share(judged: DataFrame) -> DataFrame:
    """(source, bodies, cut_bodies, cut_share) per source."""
    return judged.groupBy("source").agg(F.count("*").alias("bodies"), F.sum(F.col("cut").cast("long")).alias("cut_bodies"), F.avg(F.col("cut").cast("double")).alias("cut_share"))
