"""Steps from DataFrame to DataFrame, put together with >>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame


class Step:
    """A named transformation; ``a >> b`` runs a, then b; ``|`` is the same."""

    def __init__(self, run: Callable[[DataFrame], DataFrame], name: str = ""):
        self.run, self.name = run, name or getattr(run, "__name__", "step")

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.run(df)

    def __rshift__(self, other: Step | Callable[[DataFrame], DataFrame]) -> Step:
        other = other if isinstance(other, Step) else Step(other)
        return Step(lambda df: other(self(df)), f"{self.name} >> {other.name}")

    __or__ = __rshift__


def branch(condition: Column, yes: Step, no: Step) -> Step:
    """Rows go one of two ways, by a condition; null counts as no. Both must give the same columns."""
    from pyspark.sql import functions as F

    held = F.coalesce(condition, F.lit(False))
    return Step(lambda df: yes(df.where(held)).unionByName(no(df.where(~held))), f"branch({yes.name}, {no.name})")


def from_spec(spec: list[dict], known: dict[str, Callable[..., DataFrame]]) -> Step:
    """Steps from a list like [{"step": name, "with": {...}}], of functions known by name."""
    out = Step(lambda df: df, "start")
    for s in spec:
        out = out >> Step(lambda df, f=known[s["step"]], kw=s.get("with", {}): f(df, **kw), s["step"])
    return out


def parallel(steps: dict[str, Step], on: str) -> Step:
    """Several steps on the same rows, their results side by side by ``on``, columns named after the step. A row that one step drops has nulls there."""

    def run(df: DataFrame) -> DataFrame:
        out = df.select(on).distinct()
        for name, step in steps.items():
            made = step(df)
            out = out.join(made.select(on, *[made[c].alias(f"{name}_{c}") for c in made.columns if c != on]), on, "left")
        return out

    return Step(run, "parallel(" + ", ".join(steps) + ")")


def guarded(step: Step, fallback: Step | None = None, tries: int = 1, traces: list | None = None) -> Step:
    """A step that is tried again, then replaced by ``fallback``, when building or checking its plan raises; ``traces`` gets (name, try, error)."""

    def run(df: DataFrame) -> DataFrame:
        for n in range(max(1, tries)):
            try:
                out = step(df)
                out.schema  # noqa: B018  the plan is resolved here, so that its errors count
            except Exception as e:  # noqa: BLE001  any error of a step counts as its failure
                if traces is not None:
                    traces.append((step.name, n + 1, f"{type(e).__name__}: {e}"[:200]))
                last = e
                continue
            if traces is not None:
                traces.append((step.name, n + 1, None))
            return out
        if fallback is None:
            raise last
        return fallback(df)

    return Step(run, f"guarded({step.name})")


def cached(step: Step) -> Step:
    """A step that works out each input's result once while the input is the same plan: written in the shared folder and read again."""
    import uuid

    from corvane.session import shared_dir

    held: dict[int, str] = {}

    def run(df: DataFrame) -> DataFrame:
        key = df.semanticHash()
        if key not in held:
            held[key] = f"{shared_dir(df.sparkSession)}/corvane/cached-{uuid.uuid4().hex}"
            step(df).write.parquet(held[key])
        return df.sparkSession.read.parquet(held[key])

    return Step(run, f"cached({step.name})")


class Registry:
    """Steps by name, with tags; a name is taken once unless replaced on purpose."""

    def __init__(self) -> None:
        self._steps: dict[str, tuple[Step, frozenset[str]]] = {}

    def register(self, name: str, step: Step, tags: tuple[str, ...] = (), replace: bool = False) -> None:
        if name in self._steps and not replace:
            raise ValueError(f"{name} is registered")
        self._steps[name] = (step, frozenset(tags))

    def unregister(self, name: str) -> bool:
        return self._steps.pop(name, None) is not None

    def get(self, name: str) -> Step:
        return self._steps[name][0]

    def names(self, tag: str | None = None) -> list[str]:
        return sorted(n for n, (_, tags) in self._steps.items() if tag is None or tag in tags)
