"""Spark library for two-language training text.

Every operator takes and returns DataFrames.  Import what you need from

* ``loomtext.sources``    readers and writers
* ``loomtext.functions``  column functions
* ``loomtext.operators``  single steps
* ``loomtext.plans``      whole jobs composed of steps
* ``loomtext.streaming``  the request loops as streaming queries
"""

from loomtext.session import build_session

__all__ = ["build_session"]
