"""Callbacks by name: what responses lead to, as a polymorphic table function that is joined laterally.

A response names its callback, which gets the response and the keyword arguments that were sent along with its request. What the
callback yields becomes rows: an ``Ask`` a new request, a dict an item. Then comes one row for how it ended: ``ok``; ``drop``
after :class:`NotRetry`; after any other exception ``retry``, with the count of retries one up, or ``fail`` once these are used up. A
name that no callback has is a ``fail``. What was yielded before an exception stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Columns of all outcomes; ``item`` comes after them.
OUTCOME = "kind string, url string, callback string, cb_kwargs map<string,string>, priority int, retry_times int, reason string"


class NotRetry(Exception):
    """Raised by a callback for a response that no retry would make better."""


@dataclass
class Ask:
    """A request that a callback yields: its own callback, and what is to be sent along to that."""

    url: str
    callback: str | None = None
    cb_kwargs: Mapping[str, str] = field(default_factory=dict)
    priority: int = 300


@dataclass
class Shape(AnalyzeResult):
    """The result's columns, and the names of an item's."""

    fields: list[str] = field(default_factory=list)


def dispatcher(callbacks: Mapping[str, Callable[..., Iterable[Ask | dict[str, Any]] | None]], default: str = "parse", most_retries: int = 3):
    """A table function ``(response, item_schema)``: ``response`` is a struct that has ``url, callback, cb_kwargs, retry_times`` and what callbacks read.

    ``item_schema`` is a constant, an item's fields as a JSON schema; from it the columns of the result follow. Items
    may leave fields out, and others than these are refused like any fault of a callback.
    """
    outcome = T.StructType.fromDDL(OUTCOME).json()

    class Dispatch:
        def __init__(self, shape: Shape) -> None:
            self.fields = shape.fields

        @staticmethod
        def analyze(response: AnalyzeArgument, item_schema: AnalyzeArgument) -> Shape:
            item = T.StructType.fromJson(json.loads(item_schema.value))
            return Shape(T.StructType.fromJson(json.loads(outcome)).add("item", item), fields=item.names)

        def eval(self, response: Any, item_schema: str) -> Iterator[tuple]:
            name, tries, sent = response["callback"], response["retry_times"] or 0, dict(response["cb_kwargs"] or {})
            own = (response["url"], name, sent, None)
            callback = callbacks.get(name or default)
            if callback is None:
                yield ("fail", *own, tries, f"no callback {name!r}", None)
                return
            try:
                for made in callback(response, **sent) or ():
                    if isinstance(made, Ask):
                        yield ("request", made.url, made.callback, {k: str(v) for k, v in made.cb_kwargs.items()}, made.priority, 0, None, None)
                    else:
                        if unknown := set(made) - set(self.fields):
                            raise ValueError(f"an item has no {', '.join(sorted(unknown))}")
                        yield ("item", *own, tries, None, tuple(made.get(f) for f in self.fields))
            except NotRetry as e:
                yield ("drop", *own, tries, str(e), None)
            except Exception as e:  # noqa: BLE001
                again = tries < most_retries
                yield ("retry" if again else "fail", *own, tries + again, f"{type(e).__name__}: {e}", None)
            else:
                yield ("ok", *own, tries, None, None)

    return F.udtf(Dispatch)


def dispatch(responses: DataFrame, callbacks: Mapping[str, Callable[..., Iterable[Ask | dict[str, Any]] | None]], item_schema: str, default: str = "parse", most_retries: int = 3) -> DataFrame:
    """The outcomes of responses beside each one's own ``source`` URL; ``item_schema`` is such as ``title string, price double``.

    A response without the columns of a request lacks their values.
    """
    given = {"callback": "string", "cb_kwargs": "map<string,string>", "retry_times": "int"}
    whole = responses.withColumns({c: F.lit(None).cast(k) for c, k in given.items() if c not in responses.columns})
    one = whole.select(F.struct(*whole.columns).alias("response"))
    made = dispatcher(callbacks, default, most_retries)(F.col("response").outer(), F.lit(T.StructType.fromDDL(item_schema).json()))
    return one.lateralJoin(made).select(F.col("response")["url"].alias("source"), *(f.name for f in T.StructType.fromDDL(OUTCOME)), "item")
