"""What the tasks of one Python worker share."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def kept(key: str, make: Callable[[], object]) -> object:
    """The object made for this key by an earlier task of this worker process, or a new one. One object is kept.

    Code that travels with a query has globals of its own in every task, so the object hangs on a module that workers import.
    """
    import tokenizers

    store = tokenizers.__dict__.setdefault("_kept_by_worker", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]
