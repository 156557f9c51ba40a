"""Registries of named components, with aliases and what they accept."""

from __future__ import annotations

import importlib.metadata
from collections.abc import Callable, Iterator
from functools import partial
from dataclasses import dataclass

from ..operators import encoders, features, graphs, learners, objectives


@dataclass(frozen=True)
class Spec:
    name: str
    make: Callable | None
    accepts: tuple[str, ...] = ()
    note: str = ""


class Registry:
    def __init__(self, kind: str, entry_points: str | None = None):
        self.kind, self._specs, self._alias = kind, {}, {}
        for e in importlib.metadata.entry_points(group=entry_points) if entry_points else ():
            try:
                self.add(e.name, e.load())
            except Exception as broken:  # a plug-in that does not load must not take the others along
                self._specs.setdefault(f"!{e.name}", Spec(e.name, None, (), repr(broken)))

    def add(self, name: str, make: Callable | None = None, *aliases: str, accepts: tuple[str, ...] = (), note: str = "") -> None:
        for n in (name, *aliases):
            if n in self._specs or n in self._alias:
                raise ValueError(f"{self.kind} {n!r} is there already")
        self._specs[name] = Spec(name, make, accepts, note)
        self._alias.update(dict.fromkeys(aliases, name))

    def register(self, name: str, *aliases: str, **options) -> Callable:
        def take(f: Callable) -> Callable:
            self.add(name, f, *aliases, **options)
            return f

        return take

    def get(self, name: str) -> Spec:
        key = name.lower().replace("_", "-").strip()
        key = self._alias.get(key, key)
        if key not in self._specs:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(self)}")
        return self._specs[key]

    def __contains__(self, name: str) -> bool:
        key = name.lower().replace("_", "-").strip()
        return self._alias.get(key, key) in self._specs

    def __iter__(self) -> Iterator[str]:
        return (n for n in self._specs if not n.startswith("!"))

    def accepting(self, what: str) -> list[str]:
        return [n for n in self if what in self._specs[n].accepts]


ENCODERS, FUSIONS, GRAPHS, OBJECTIVES, MODELS = (Registry(k) for k in ("encoder", "fusion", "graph", "objective", "model"))
for _n, _c in encoders.ENCODERS.items():
    ENCODERS.add(_n, _c, accepts=tuple(dict.fromkeys((*_c.accepts, *(("embedding",) if _n in ("raw", "pca") else ())))))
ENCODERS.add("ica", features.fast_ica, accepts=("tabular",))
for _n, _a in (("autoencoder", "tabular"), ("vae", "tabular"), ("contrastive", "tabular"), ("masked-feature", "tabular"), ("cnn-patch", "raster"), ("multiscale-cnn", "raster"), ("vision-backbone", "raster"), ("recurrent", "sequence"), ("temporal-cnn", "sequence"), ("temporal-transformer", "sequence")):
    ENCODERS.add(_n, None, accepts=(_a,), note="SKIPPED_DEPENDENCY")
for _n, _c in encoders.FUSIONS.items():
    FUSIONS.add(_n, _c)
for _n in ("cross-attention",):
    FUSIONS.add(_n, None, note="SKIPPED_DEPENDENCY")
for _n, _f in (("geographic-knn", graphs.geographic_knn), ("geographic-radius", graphs.radius_edges), ("environmental-knn", graphs.environmental_knn), ("hybrid", graphs.hybrid_knn), ("patch-adjacency", graphs.patch_adjacency), ("user", graphs.user_graph)):
    GRAPHS.add(_n, _f)
for _n, _f in (("bce", objectives.bce), ("weighted-bce", objectives.weighted_bce), ("focal", objectives.focal), ("pairwise-ranking", objectives.pairwise_ranking), ("maxent", objectives.maxent), ("poisson", objectives.poisson), ("deepmaxent", objectives.deep_maxent)):
    OBJECTIVES.add(_n, _f)
for _n in learners.AVAILABLE:
    MODELS.add(_n, partial(learners.predict, _n), accepts=("tabular",))
for _n, _s in learners.UNAVAILABLE.items():
    MODELS.add(_n, None, accepts=("tabular", "graph") if _n in ("gcn", "graphsage", "gatv2", "graph-transformer") else ("tabular",), note=_s)

@dataclass(frozen=True)
class ModalityDefinition:
    """What a modality usually is: its kind, variables and encoder."""

    name: str
    kind: str
    variables: tuple[str, ...] = ()
    encoder: str = "raw"
    notes: str = ""


#: Usual modalities.
STANDARD_MODALITIES = {
    m.name: m
    for m in (
        ModalityDefinition("climate", "tabular", ("temperature", "precipitation"), "standardized"),
        ModalityDefinition("terrain", "raster", ("elevation", "slope", "aspect"), "patch-statistics"),
        ModalityDefinition("soil", "tabular", ("ph", "texture"), "standardized"),
        ModalityDefinition("vegetation", "categorical", ("class",), "categorical"),
        ModalityDefinition("landcover", "categorical", ("class",), "categorical"),
        ModalityDefinition("hydrology", "tabular", ("distance to water",), "standardized"),
        ModalityDefinition("imagery", "raster", ("bands",), "patch-statistics"),
        ModalityDefinition("phenology", "sequence", ("greenness",), "temporal-summary"),
        ModalityDefinition("embedding", "embedding", (), "identity-embedding"),
    )
}

#: Sets of models by name.
MODEL_SETS = {"standard": ("logistic-regression", "random-forest-mllib", "gradient-boosting", "knn", "gaussian-nb", "dummy"), "classical": ("logistic-regression", "knn", "decision-tree", "gaussian-nb"), "boosting": ("gradient-boosting", "adaboost", "xgboost", "lightgbm", "catboost"), "graph": ("gcn", "graphsage", "gatv2", "graph-transformer"), "published": ("maxnet", "random-forest", "brt", "gam", "tabpfn-sdm")}


def resolve_models(names: list[str] | str) -> list[str]:
    """Sets and names to names, once each, in order."""
    parts = names.split(",") if isinstance(names, str) else names
    out: list[str] = []
    for n in (p.strip().lower() for p in parts):
        if n:
            out += list(MODELS) if n == "all" else MODEL_SETS[n] if n in MODEL_SETS else [MODELS.get(n).name]
    return list(dict.fromkeys(out))
