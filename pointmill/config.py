"""Parameters of a segmentation run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SegmentationConfig:
    """Defaults equal the documented command line; ``curvature_percentile`` is honoured.

    ``max_component`` is the number of points up to which a connected component is merged by one task; larger ones
    are merged in levels over many tasks, with the same labels.  ``level_share`` is the share of edges, by the number of regions,
    in the first level; it sets the pace, not the result.
    """

    normal_radius: float = 0.5
    search_radius: float = 0.5
    angle_threshold: float = 0.52
    curvature_percentile: int = 98
    angle_weight: float = 0.5
    curvature_weight: float = 1.0
    stop_weight: float | None = None
    gates: bool = True
    inclusive: bool = True
    voxel_size: float = 0.4
    num_classes: int = 9
    max_component: int = 500_000
    level_share: float = 0.05
    bundle_edges: int = 500_000


CLASS_NAMES = {
    0: "unlabeled",
    1: "man-made terrain",
    2: "natural terrain",
    3: "high vegetation",
    4: "low vegetation",
    5: "buildings",
    6: "hard scape",
    7: "scanning artefacts",
    8: "cars",
}
