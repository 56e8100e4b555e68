"""Every operator by its key, for graphs: functions of wired tables and parameters.

Operators whose model or solver is a package of its own are registered too; they refuse with a message
that names what is missing, and hook() puts an implementation in their place.
"""

from __future__ import annotations

from collections.abc import Callable

from ..core import Refusal
from ..operators import axes as A
from ..operators import compose as C
from ..operators import figure as G
from ..operators import fits as X
from ..operators import image as I
from ..operators import spatial as S
from ..operators import tables as T
from ..operators import tensor as N
from ..operators import transfer as D
from ..operators import windows as W
from ..sources import io as IO
from ..streaming import zones as Z
from . import graph


def needs(what: str) -> Callable:
    def refuse(*_, **__):
        raise Refusal(f"this operator needs {what}, which is not installed; register one with hook()")

    refuse.hook = True
    return refuse


def same(df, *_, **__):
    return df


def enhance(key: str) -> Callable:
    return lambda df, **p: I.enhance(df, key, **p)


def only(f: Callable, mode: str, built: str, default: str) -> Callable:
    """f where the parameter `mode` (by default `default`, as in the survey) is the one that is built in; others are refused by name."""

    def run(*tables, **p):
        asked = p.pop(mode, default)
        if asked != built:
            raise Refusal(f"{mode} {asked!r} is not covered; {mode} {built!r} is built in")
        return f(*tables, **p)

    return run


def if_else(df, **p):
    ok, fail = T.if_else(df, **p)
    return {"pass": ok, "fail": fail}


def track_objects(df, method: str = "centroid", **p):
    if method == "centroid":
        return S.link_points(df, **p)
    if method == "overlap":
        return S.link_labels(df, **p)
    raise Refusal(f"the linker {method!r} needs its own solver; centroid and overlap are built in")


def detect_fold(df, metrics=("velocity",), n_neighbors: int = 6, intensity: str = "mean_intensity", dt: float = 1.0):
    for m in metrics:
        if m in ("velocity", "speed"):
            df = W.velocity(df, dt)
        elif m == "neighbors":
            df = W.neighbour_metrics(df, n_neighbors)
        elif m == "frame_fold":
            df = W.frame_fold(df, intensity)
        elif m == "self_fold":
            df = W.self_fold(df, intensity)
        else:
            raise Refusal(f"unknown metric {m!r}")
    return df


def distribution(df, value: str, kind: str = "histogram", **p):
    return {"histogram": G.histogram, "kde": G.kde, "box": G.box, "violin": G.kde, "ecdf": G.ecdf}[kind](df, value, **p)


def transfer_structure(source, *more, hop: str, **p):
    """One bridge by name, such as voxel>label."""
    table = {
        "voxel>label": D.voxel_to_label, "label>voxel": D.label_to_voxel, "voxel>point": D.voxel_to_point, "point>voxel": D.point_to_voxel, "point>label": D.point_to_label, "label>point": D.label_to_point,
        "label>track": D.member_to_track, "point>track": D.member_to_track, "track>label": D.track_to_member, "track>point": D.track_to_member, "track>timepoint": D.track_to_timepoint, "timepoint>track": D.timepoint_to_track,
        "label>frame": D.member_to_frame, "point>frame": D.member_to_frame, "frame>label": D.frame_to_member, "frame>point": D.frame_to_member,
    }
    if hop not in table:
        raise Refusal(f"no bridge {hop}; there are {', '.join(table)}")
    return table[hop](source, *more, **p)



OPERATORS: dict[str, Callable] = {
    # scans, sources, sinks
    "io.load": IO.load, "io.load_analysis": IO.load_analysis, "io.write_table": IO.write_table, "io.write_tiff": IO.write_tiff, "io.write_movie": IO.write_movie, "io.write_html": IO.write_html, "io.write_figure": IO.write_figure, "io.dock": IO.dock,
    # selection
    "channel.select": A.select_channels, "channel.split": lambda df, size: dict(enumerate(A.split(df, "c", size))), "util.crop": A.crop, "util.crop_region": A.crop_region, "util.crop_to": A.crop_to, "util.select_position": A.select_position, "util.select_plane": A.select_plane, "util.select_frame": A.select_frame,
    "util.select_group": A.select_group, "util.select_batch": A.select_batch, "util.split_positions": lambda df, size: dict(enumerate(A.split(df, "m", size))), "util.split_z": lambda df, groups: dict(enumerate(A.ranges(df, "z", groups))), "util.split_t": lambda df, groups: dict(enumerate(A.ranges(df, "t", groups))),
    "util.trim": A.trim, "util.time_shift": A.time_shift_image, "analysis.filter_labels": T.filter_labels, "analysis.if_else": if_else, "table.curate_objects": T.curate_objects,
    # joins
    "table.join": T.join, "table.unique_objects": S.unique_objects, "table.register_positions": S.register_positions, "track.link": S.link_points, "track.objects": track_objects, "analysis.voronoi": S.voronoi, "analysis.boundary_band": S.boundary_band, "transform.transfer_structure": transfer_structure,
    "transform.rasterize_field": C.rasterize_field, "transform.rasterize_mesh": I.rasterize_mesh, "transform.grow_points": S.grow_points, "registration.align_to": C.align_image, "view.overlay": S.overlay, "view.canvas": S.canvas,
    # unions
    "table.concat": lambda *t, **p: T.concat(t, **p), "util.merge": lambda *t, axis, sizes: A.merge(t, axis, sizes), "util.timeseries": lambda *t, **p: A.timeseries(t, **p), "util.batch": lambda *t: A.batch(t), "util.unbatch": lambda df, size: dict(enumerate(A.split(df, "b", size))), "math.mask": T.mask_math, "util.stitch": A.stitch,
    # aggregations
    "table.aggregate": T.aggregate, "analysis.reduce_scalar": T.reduce_scalar, "transform.transfer_domain": D.lattice, "transform.label_to_points": D.label_to_points, "analysis.measure": D.measure, "util.zproject": A.zproject, "util.stack": A.stack, "util.resample": I.resample, "analysis.object_field": W.object_field,
    # sequences
    "analysis.object_metrics": detect_fold, "analysis.track_field": C.track_field, "analysis.accumulate_field": W.accumulate_field, "enhance.temporal_gain": W.temporal_gain, "enhance.normalize": W.normalize, "piv.validate": W.piv_validate, "piv.smooth": enhance("piv.smooth"),
    # arithmetic and tensors
    "math.values": T.values, "math.image": T.image, "enhance.gamma": W.gamma, "field.gradient": N.gradient, "field.strain": N.strain, "field.rotation": N.rotation, "field.volume_change": N.volume_change, "field.stress": N.stress, "dic.strain": C.field_strain, "dvc.strain": C.field_strain,
    # fits
    "table.standard_curve": X.standard_curve, "table.point_source_fit": X.point_source_fit, "analysis.cluster_points": X.cluster_points, "analysis.gradient_map": C.gradient_map,
    # segmentation and detection
    "analysis.threshold": I.threshold, "analysis.threshold_local": enhance("analysis.threshold_local"), "analysis.multiotsu": I.multiotsu, "analysis.histogram_threshold": I.histogram_threshold, "analysis.label": I.label, "analysis.segment": I.segment, "analysis.edt": enhance("analysis.edt"), "analysis.roi_mask": S.roi_mask,
    "analysis.draw_regions": S.draw_regions, "analysis.extract_boundary": S.extract_boundary, "analysis.tessellate": I.tessellate, "detect.spots": I.spots, "detect.particles": I.particles, "detect.beads": I.beads,
    # enhancement and registration
    **{k: enhance(k) for k in I.FILTERS if k.startswith("enhance.")}, "enhance.remove_blobs": I.remove_blobs, "enhance.zs_deconvnet": needs("a neural network library"), "align.drift": I.align_drift, "align.shift": I.shift, "registration.stabilize": only(I.align_drift, "model", "translation", "translation"), "transform.rigid": I.rigid,
    # correlation and flow
    "analysis.optical_flow": I.optical_flow, "analysis.piv": I.piv, "piv.first_pass": lambda df, **p: I.piv(df, passes=1, **p), "piv.deform_pass": lambda df, **p: I.piv(df, passes=2, **p), "dic.grid": N.grid, "dic.initial_guess": I.initial_guess, "dvc.grid": N.grid, "dvc.initial_guess": I.initial_guess,
    **{k: needs("an image correlation solver") for k in ("analysis.dic_correlate", "dic.refine_mesh", "dic.local_match", "dic.global_step", "analysis.dvc_field", "dvc.local_match", "dvc.global_step")},
    # figures
    "plot.xy": C.xy, "plot.timeseries": G.timeseries, "plot.distribution": distribution, "plot.heatmap": G.heatmap, "plot.field": G.field_limits,
    # control flow
    "flow.iterate": lambda *_, build, **p: graph.sweep(build, **p)[1], "flow.advance": lambda *_, **p: graph.advance(**p), "zone.repeat_in": same, "zone.repeat_out": same, "zone.sim_in": same, "zone.sim_out": lambda df, **p: Z.simulate(df, **p), "zone.frame": Z.frame,
    "group.input": same, "group.output": same, "rr.reroute": same, "view.viewer": same, "page.input": same, "page.output": lambda df, name: T.concat([df], [name]), "data.part": lambda data, domain, name="": data.layer(domain, name),
}

graph.OPERATORS.update(OPERATORS)


def hook(key: str, f: Callable) -> None:
    """Puts an implementation in the place of an operator that needs a package."""
    if not getattr(OPERATORS.get(key), "hook", False):
        raise Refusal(f"{key} is not an operator with a hook")
    OPERATORS[key] = graph.OPERATORS[key] = f
