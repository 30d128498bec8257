"""Parameters of a run, checked once and passed on explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.pieces import Pieces


@dataclass(frozen=True)
class AttractorConfig:
    """``broken_chains``: a chain that breaks for too many gaps is judged too, not only a segment's last."""

    distance_threshold: float = 100.0
    approach_ratio: float = 0.5
    min_proximity: float = 20.0
    time_persistence: int = 6
    max_gaps: int = 4
    broken_chains: bool = False
    attractor_types: tuple[str, ...] = ()
    attracted_types: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.time_persistence < 1 or self.max_gaps < 0:
            raise ValueError("time_persistence must be at least 1 and max_gaps at least 0")


@dataclass(frozen=True)
class MLConfig:
    """``search``: hyper-parameters are searched, in ``grid`` and by ``draws`` points of it if given, else in the fixed grids; without it they are ``depth``, ``trees`` and ``learning_rate``."""

    categories: tuple[str, ...] = ()
    min_samples: int = 5
    min_samples_trees: int = 10
    variance: float = 0.01
    correlation: float = 0.95
    explained: float = 0.95
    test_share: float = 0.4
    seed: int = 42
    drop_non_moving: bool = False
    depth: int = 3
    trees: int = 10
    learning_rate: float = 0.3
    search: bool = True
    draws: int = 0
    grid: dict[str, list] = field(default_factory=dict)


@dataclass(frozen=True)
class RunConfig:
    """``arrest_limit`` 0 turns the moving filter off; the flags after ``helicity`` choose documented variants of an operator.

    ``piece_rows`` 0: a window holds a whole track; else tracks are cut into pieces of so many rows, with the same results.
    """

    dt: float = 1.0
    tau: int = 10
    arrest_limit: float = 3.0
    moving: int = 4
    contact_length: float = 12.0
    arrested: float = 0.95
    min_max_euclid: float = 0.0
    multitrack: bool = False
    interpolate: bool = False
    contacts: bool = False
    contact_div_filter: bool = False
    attractors: bool = False
    helicity: bool = False
    verbose: bool = False
    wide: bool = True
    hull_times_duration: bool = False
    median_of_angles: bool = False
    euclidean_contacts: bool = False
    both_sides_dead: bool = False
    both_sides_contacts: bool = False
    piece_rows: int = 0
    attractor: AttractorConfig = field(default_factory=AttractorConfig)
    ml: MLConfig = field(default_factory=MLConfig)

    def __post_init__(self) -> None:
        if self.dt <= 0 or self.tau < 1 or self.moving < 1:
            raise ValueError("dt must be positive; tau and moving at least 1")

    @property
    def pieces(self) -> Pieces | None:
        return Pieces(self.piece_rows, self.piece_rows * self.dt) if self.piece_rows else None


def words(text: str | None) -> tuple[str, ...]:
    """A list of category names as typed: split at white space, blank gives none."""
    return tuple((text or "").split())
