"""Parameter sets of the keyframe pipeline, with the presets of its entry points."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TableConfig:
    """Plane fit of the table top."""

    voxel: float = 0.005
    remove_outliers: bool = True
    neighbours: int = 30
    std_ratio: float = 2.0
    distance: float = 0.008
    iterations: int = 2000
    min_inlier_ratio: float = 0.20
    thickness: float = 0.008
    keep_only_above: bool = False
    up: tuple[float, float, float] | None = None
    max_angle_deg: float = 25.0


@dataclass(frozen=True)
class MaskConfig:
    """Masks of the objects on the table."""

    band: float = 0.012
    close: int = 21
    dilate: int = 3
    table_erode: int = 21
    table_min_area: int = 5000
    clearance: float = 0.015
    max_distance: float = 0.60
    open_objects: int = 3
    close_objects: int = 3
    dilate_objects: int = 1
    min_component_area: int = 400
    eps: float = 0.015
    min_samples: int = 80
    min_cluster_points: int = 200
    object_close: int = 3
    object_dilate: int = 1
    min_object_area: int = 200
    min_extent: float = 0.01
    max_extent: float = 0.50
    max_height_extent: float = 0.50
    min_median_height: float = 0.01
    merged_points: int = 1200
    merged_area: int = 2500
    merged_side: int = 120
    peak_ratio: float = 0.38
    min_peak_area: int = 300
    bottom_band: float = 0.02
    min_bottom_pixels: int = 80
    min_inside_ratio: float = 0.60
    edge_margin: int = 12
    edge_min_inside_ratio: float = 0.75
    min_final_points: int = 150


@dataclass(frozen=True)
class SplitConfig:
    """Secondary split of merged objects."""

    enable: bool = True
    min_points: int = 1800
    min_points_each: int = 180
    min_extent: float = 0.08
    min_second_ratio: float = 0.15
    min_center_distance: float = 0.025
    min_gap: float = 0.006
    min_mask_area: int = 180
    min_gain: float = 2.0
    knn_k: int = 20
    low_density_percentile: float = 20.0
    density_factor: float = 1.15
    radius: float = 0.018
    recursive_min_points: int = 800
    recursive_min_extent: float = 0.05
    max_depth: int = 2
    depth_jump: float = 0.01
    min_connectivity: float = 0.80
    min_depth_connectivity: float = 0.55
    min_density: float = 8000.0
    boundary_kernel: int = 7
    min_boundary_score: float = 0.08
    peak_ratio: float = 0.45
    min_peak_area: int = 200
    voxel: float = 0.003
    neighbours: int = 20
    std_ratio: float = 1.5


@dataclass(frozen=True)
class StateConfig:
    """Tracks over keyframes."""

    min_points: int = 50
    voxel: float = 0.003
    neighbours: int = 20
    geometry_neighbours: int = 30
    std_ratio: float = 1.5
    geometry_min_points: int = 180
    geometry_min_accumulated: int = 200
    confirmations: int = 3
    least_confidence: str = "medium"
    match_distance: float = 0.10
    update_templates: bool = False


@dataclass(frozen=True)
class FusionConfig:
    """Fusion over a recording."""

    warmup_frames: int = 10
    max_keyframes: int = 300
    match_distance: float = 0.10
    voxel: float = 0.003
    neighbours: int = 30
    std_ratio: float = 1.5
    eps: float = 0.012
    min_samples: int = 20
    keep_cluster_ratio: float = 0.15


#: The runners' settings: all fit the plane alike; the fusion runner asks less support of a mask, the refining one keeps smaller objects too.
RUNNER_TABLE = replace(TableConfig(), remove_outliers=False, distance=0.01, iterations=3000, min_inlier_ratio=0.10, thickness=0.012)
VIDEO_MASK = replace(MaskConfig(), min_object_area=400)
FUSION_MASK = replace(VIDEO_MASK, object_close=5, min_bottom_pixels=40, min_inside_ratio=0.45, edge_min_inside_ratio=0.60)
REFINED_MASK = replace(FUSION_MASK, table_erode=9, min_cluster_points=150)
