"""Stateful processors that run a fold per key, for all keys of a bucket in one call."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "state string"


def _changes(column: pd.Series) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal."""
    value, none = column.to_numpy(), column.isna().to_numpy()
    return (none[1:] != none[:-1]) | (~none[1:] & (value[1:] != value[:-1]))


def _column(parts: list[pd.DataFrame], name: str) -> np.ndarray:
    kinds = {part[name].dtype for part in parts}
    return np.concatenate([part[name].to_numpy() if len(kinds) == 1 else part[name].to_numpy(object) for part in parts])


class FoldProcessor(StatefulProcessor):
    """Runs ``fold`` over each trigger's rows of a key, in order, with its state kept as JSON.

    Rows are grouped by a bucket of keys: calls, state reads and writes cost the same for a key as for a bucket. The state of a bucket is a list of
    its keys with their states; states of keys without rows in a trigger are handed on as text.
    ``initial state`` rows, one a bucket, carry such a list to start from in a column ``state``.
    """

    def __init__(self, fold, keys: list[str], order: list[str]):
        self.fold, self.keys, self.order = fold, keys, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", STATE)

    def _load(self) -> dict[tuple, str]:
        found = self.state.get() if self.state.exists() else None
        return {tuple(held.get(name) for name in self.keys): held["state"] for held in json.loads(found[0])} if found else {}

    def _store(self, states: dict[tuple, str]) -> None:
        self.state.update((json.dumps([dict(zip(self.keys, key)) | {"state": text} for key, text in states.items()]),))

    def _parts(self, pdf: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        """Key and rows, in order, of each key."""
        pdf = pdf.sort_values([*self.keys, *self.order], kind="stable", ignore_index=True)
        first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([_changes(pdf[name]) for name in self.keys])])).tolist()
        for a, b in zip(first, [*first[1:], len(pdf)]):
            values = [pdf[name].iat[a] for name in self.keys]
            yield tuple(None if pd.isna(v) else v.item() if isinstance(v, np.generic) else v for v in values), pdf.iloc[a:b]

    def _together(self, made: list[tuple[tuple, pd.DataFrame]], late: dict[tuple, int] | None = None) -> pd.DataFrame | None:
        """The rows made for each key as one table with the key columns, and the count ``late`` if it is given."""
        made = [(key, part) for key, part in made if len(part)]
        if not made:
            return None
        parts, size = [part for _, part in made], [len(part) for _, part in made]
        out = pd.DataFrame({name: _column(parts, name) for name in parts[0].columns})
        for i, name in enumerate(self.keys):
            out[name] = np.repeat(pd.Series([key[i] for key, _ in made], dtype=object).to_numpy(), size)
        if late is not None:
            out["late"], out["late_row"] = np.repeat([late.get(key, 0) for key, _ in made], size), None
        return out

    def _run(self, pdf: pd.DataFrame) -> list[tuple[tuple, pd.DataFrame]]:
        states, made = self._load(), []
        for key, part in self._parts(pdf):
            out, state = self.fold(json.loads(states[key]) if key in states else None, part)
            states[key] = json.dumps(state)
            made.append((key, out))
        self._store(states)
        return made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if parts:
            out = self._together(self._run(pd.concat(parts, ignore_index=True)))
            if out is not None:
                yield out

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if len(initialState):
            self.state.update((initialState["state"].iloc[0],))


class ReorderProcessor(FoldProcessor):
    """Holds rows until the watermark has passed them, so the fold sees them in event order.

    Waiting rows of a bucket lie in a map from time range (``range_ms`` wide) to rows, so that a release reads the ranges that the watermark has
    reached and no others. Rows at or behind the watermark cannot be put in order any more: they are counted per key in ``late`` and come out
    as JSON in ``late_row``, beside the fold's rows (columns ``made``). With ``flush`` given, a key whose last row lies ``flush_ms`` behind the watermark
    emits its closing rows. A bucket has one timer for its next range and one for the next key to close.
    """

    def __init__(self, fold, keys, order, event_ms: str, columns: list[str], made: list[str], flush=None, flush_ms: int = 0,
                 range_ms: int = 60_000):
        super().__init__(fold, keys, order)
        self.event_ms, self.columns, self.made = event_ms, columns, made
        self.flush, self.flush_ms, self.range_ms = flush, flush_ms, range_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "range bigint", "rows string")
        self.meta = handle.getValueState("meta", "late string, open string, closed string, ranges string")

    def _meta(self) -> tuple[dict[tuple, int], dict[tuple, int], set[tuple], list[int]]:
        """Late rows of keys, newest time of keys still to be closed, closed keys, waiting ranges."""
        found = self.meta.get() if self.meta.exists() else None
        late, still, closed, ranges = map(json.loads, found) if found else ([], [], [], [])
        return {tuple(k): n for k, n in late}, {tuple(k): n for k, n in still}, {tuple(k) for k in closed}, ranges

    def _save(self, late: dict[tuple, int], still: dict[tuple, int], closed: set[tuple], ranges: list[int]) -> None:
        self.meta.update(tuple(json.dumps(list(x)) for x in (late.items(), still.items(), closed, ranges)))
        if still:
            self.handle.registerTimer(min(still.values()) + self.flush_ms)

    def _keep(self, rows: pd.DataFrame, ranges: list[int]) -> list[int]:
        for number, part in rows.groupby(rows[self.event_ms] // self.range_ms, sort=False):
            number = int(number)
            held = json.loads(self.waiting.getValue((number,))[0]) if number in ranges else []
            more = json.loads(part[[*self.columns, *self.keys]].to_json(orient="values", double_precision=15))
            self.waiting.updateValue((number,), (json.dumps(held + more),))
            ranges = sorted({*ranges, number})
        return ranges

    def _release(self, watermark: int, late: dict[tuple, int], ranges: list[int]) -> tuple[list[pd.DataFrame], list[int]]:
        at, ready, left = self.columns.index(self.event_ms), [], []
        for number in ranges:
            if number * self.range_ms > watermark:
                left.append(number)
                continue
            rows = json.loads(self.waiting.getValue((number,))[0])
            rest = [r for r in rows if r[at] > watermark]
            ready += [r for r in rows if r[at] <= watermark]
            if rest:
                self.waiting.updateValue((number,), (json.dumps(rest),))
                left.append(number)
            else:
                self.waiting.removeKey((number,))
        if left:  # wakes when the watermark has reached more of the next range
            self.handle.registerTimer(max(left[0] * self.range_ms, watermark + 1))
        if not ready:
            return [], left
        out = self._together(self._run(pd.DataFrame(ready, columns=[*self.columns, *self.keys])), late)
        return [] if out is None else [out], left

    def _late_rows(self, part: pd.DataFrame, late: dict[tuple, int]) -> pd.DataFrame | None:
        """Counts the rows of ``part`` in ``late`` and returns them as they are."""
        made = []
        for key, rows in self._parts(part):
            late[key] = late.get(key, 0) + len(rows)
            texts = [json.dumps(r) for r in json.loads(rows[self.columns].to_json(orient="records", double_precision=15))]
            made.append((key, pd.DataFrame({**{name: [None] * len(texts) for name in self.made}, "_text": texts})))
        out = self._together(made, late)
        return out.assign(late_row=out["_text"]).drop(columns="_text")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        late, still, closed, ranges = self._meta()
        for part in rows:
            behind = part[self.event_ms] <= watermark
            if behind.any():
                yield self._late_rows(part.loc[behind], late)
            keep = part.loc[~behind]
            if len(keep):
                ranges = self._keep(keep, ranges)
                if self.flush:
                    for one, mine in self._parts(keep[[*self.keys, *dict.fromkeys([*self.order, self.event_ms])]]):
                        if one not in closed:
                            still[one] = max(still.get(one, -1), int(mine[self.event_ms].max()))
        out, ranges = self._release(watermark, late, ranges)
        self._save(late, still, closed, ranges)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        late, still, closed, ranges = self._meta()
        out, ranges = self._release(watermark, late, ranges)
        due = [one for one, newest in still.items() if watermark >= newest + self.flush_ms]
        if due:
            states = self._load()
            last = self._together([(one, self.flush(json.loads(states[one]) if one in states else None)) for one in due], late)
            for one in due:
                del still[one]
            closed.update(due)
            if last is not None:
                out.append(last)
        self._save(late, still, closed, ranges)
        yield from out
