"""Queries next to their SQL on the smallest tables, and what every entry point must be."""

import duckdb
import pytest
from gridloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each family; tools/compare.py runs all.
SOME = [
    "flagship", "tools_comp_div", "tools_csg_difference", "tree_topology_union", "tools_merge_first", "tools_clip_mask", "tree_fill", "tools_deactivate", "tools_gradient_inactive_neighbours", "tools_mean_curvature", "tools_curl", "tools_filter_mean", "tools_dilate_18", "tools_erode_26",
    "tools_statistics", "nano_grid_stats", "tools_level_set_measure", "tools_box_sampler", "tools_quadratic_sampler", "tools_prune", "tree_voxelize", "tools_multires_restrict", "tools_multires_prolong", "tools_segmentation", "tools_signed_flood_fill", "tools_poisson_jacobi", "tools_fast_sweeping",
    "tools_change_background", "tools_set_value_on_mult", "tools_active_in_boxes", "tools_extrema", "tools_prune_level_set", "tools_euler_characteristic", "tools_volume_to_mesh_vertices", "tools_volume_to_mesh_quads", "tools_level_set_rebuild", "tools_particle_trails", "tools_mesh_to_unsigned_distance", "tools_level_set_icosahedron", "tools_topology_to_level_set",
    "points_delete", "points_string_codes", "points_principal_spread", "points_advect_runge_kutta", "points_rasterize_smooth_spheres", "ax_exponents_and_angles", "ax_volume_functions",
    "tools_level_set_track", "tools_level_set_advect", "tools_check_level_set", "tools_sdf_extension", "tools_merge_csg_difference", "tools_mesh_to_level_set", "points_project", "points_scatter_by_value", "points_frustum_raster", "tools_clip_frustum", "ax_matrix4_functions",
    "tools_staggered_sampler", "tools_level_set_curvature_flow", "points_scatter", "tools_fog_to_sdf", "tools_fog_to_extension", "tools_level_set_morphing", "tools_volume_to_mesh_adaptive", "tools_potential_flow_walls", "tools_potential_flow_velocities",
    "tools_closest_surface_point", "tools_fill_with_spheres", "points_local_axes", "points_rasterize_ellipsoids", "points_advect_constrained", "tools_dense_extract", "tools_dense_composite_over", "tools_fracture", "tools_fracture_volumes",
    "points_offsets", "points_level_set_filter", "points_rasterize_mean", "points_radius_search", "points_closest", "ax_scalar_functions", "ax_matrix_functions", "ax_colour_round_trip", "stream_windowed_voxels",
    "math_ray_voxels", "math_ray_hits", "math_ray_integral", "tools_active_runs", "tools_grid_transform", "tools_level_set_normalise", "tools_level_set_morph", "tools_particles_to_level_set", "math_gradient_forward", "points_nearest", "ax_modulo_functions", "ax_matrix_inverse", "ax_sort_functions", "ax_leaf_offsets",
]


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_rows_equal_the_sqls(spark, tiny, duck, name):
    df = catalog.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    theirs = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[n] for n in at)) for r in theirs.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())
