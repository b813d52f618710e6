"""What a model client is: ``complete(prompts) -> replies``, one reply per prompt.

A client is pickled to the tasks, so it must be cheap until its first call.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol


class Client(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[str]: ...
