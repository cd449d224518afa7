"""Spark schemas of sections, weak labels, samples and answers. Lengths are millimetres, all numbers doubles."""

from __future__ import annotations

POINTS = "section_id string, section_name string, source string, name string, ord int, x double, y double, z double"
CURVES = (
    "section_id string, section_name string, source string, name string, ord int, start string, end string,"
    " c1 struct<x: double, y: double, z: double>, c2 struct<x: double, y: double, z: double>"
)
REGIONS = "section_id string, ord int, name string, function string, notes string, bbox map<string, string>"
META = "section_id string, family string, topology string, version string, meta string"

UV = "struct<u: double, v: double>"
SECTION_POINTS = f"name string, ord int, uv {UV}"
SECTION_CURVES = f"name string, ord int, start string, end string, polyline array<{UV}>, length double, chord double"

EDGES = f"section_id string, edge_id int, curve string, sub_index int, node_a string, node_b string, polyline array<{UV}>, length double, is_bridge boolean"
FACES = (
    "section_id string, face_id string, ord int, is_sub boolean, parent string, waist_ratio double, area double, cu double, cv double,"
    f" u0 double, v0 double, u1 double, v1 double, polygon array<{UV}>, curves array<string>, points array<string>, edge_ids array<int>"
)
CURVE_TOPO = (
    "section_id string, name string, n_cells int, cell_ids array<string>, on_outer boolean, dangling boolean, chain_id int,"
    " chain_length double, component_id int, transition_like boolean, transition_convex boolean, run_id int"
)
POINT_TOPO = "section_id string, name string, rep string, degree int, on_outer boolean, is_tip boolean, component_id int"
#: One row per kind and section: the kernel's tables travel together, as a kernel has one output.
GRAPH = "section_id string, kind string, row string"

SILVER = (
    "section_id string, ord int, region_name string, function string, label_id string, entity_type string, face_ids array<string>,"
    " curve_names array<string>, point_names array<string>, ordinal int, flags array<string>, match_score double"
)
SAMPLES = (
    "sample_id string, section_id string, family string, label_id string, entity_type string, kind string, query_text string, ordinal int,"
    " target_curves array<string>, target_faces array<string>, target_points array<string>, source_regions array<string>, flags array<string>"
)
