"""Column layouts of the tables that operators exchange."""

POINTS = "point_id bigint, x double, y double, z double"
ORIENTED = POINTS + ", nx double, ny double, nz double"
REJECTS = "line_num bigint, text string"
FEATURES = "point_id bigint, n_neighbors bigint, x double, y double, z double, nx double, ny double, nz double, curvature double"
EDGES = "edge_id bigint, src bigint, dst bigint, weight double"
LABELS = "point_id bigint, segment_id bigint"
REGIONS = "segment_id bigint, root bigint, size bigint, x double, y double, z double, nx double, ny double, nz double"
TRUTH = "point_id bigint, class_id int"
CONFUSION = "gt int, pred int, n bigint"
XYZ = ["x", "y", "z"]
NORMAL = ["nx", "ny", "nz"]
