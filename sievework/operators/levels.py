"""How much of a structured prompt each named level of degradation keeps. Fixed values, as text."""

from __future__ import annotations

# Fixed values. Columns: share of descriptions kept; of settings; of atmosphere and lighting; of usual styles; of
# other usual photographic values; of usual perspectives of an element; of unusual values of all these; strength and
# decay of falling lists; decay for relationships; share of properties kept; then what is dropped: background and
# foreground elements, positions and depths, relationships, and positions and depths of an element together.
_COLUMNS = "description setting ambience style photography perspective unusual strength decay relation_decay property drop_background drop_foreground drop_place drop_relation drop_both"
_ROWS = """
l10            1.0  1.0 1.0 1.0 1.0 1.0 1.0  1.0 0.0  0.0 1.0  0.0 0.0 0.0 0.0  0.0
l10_dropAllPD  1.0  1.0 1.0 1.0 1.0 1.0 1.0  1.0 0.0  0.0 1.0  0.0 0.0 0.0 0.0  0.5
l9             1.0  1.0 0.5 0.2 0.2 0.5 1.0  1.0 0.5  0.5 0.8  0.0 0.0 0.0 0.0  0.0
l8.5           1.0  1.0 0.5 0.2 0.2 0.5 1.0  1.0 0.65 0.5 0.75 0.1 0.0 0.2 0.25 0.0
l8             1.0  1.0 0.5 0.2 0.2 0.5 1.0  1.0 0.65 0.5 0.75 0.3 0.0 0.2 0.5  0.0
l8_dropBGFG    1.0  1.0 0.5 0.2 0.2 0.5 1.0  1.0 0.65 0.5 0.75 0.5 0.2 0.2 0.5  0.0
l7             1.0  1.0 0.5 0.2 0.2 0.5 1.0  1.0 0.65 0.5 0.5  0.5 0.0 0.3 0.5  0.0
l6             0.75 1.0 0.3 0.1 0.1 0.2 0.75 1.0 1.0  1.0 0.5  0.6 0.0 0.4 0.6  0.0
l5             0.75 1.0 0.3 0.1 0.1 0.2 0.5  0.8 1.0  1.0 0.5  0.6 0.1 0.5 0.7  0.0
l4             0.5  0.8 0.3 0.1 0.1 0.2 0.5  0.8 1.0  1.0 0.4  0.7 0.2 0.6 0.8  0.0
l3             0.3  0.5 0.1 0.1 0.1 0.2 0.25 0.6 1.0  1.0 0.3  0.8 0.3 0.7 0.9  0.0
l2             0.3  0.3 0.1 0.1 0.1 0.1 0.1  0.2 1.0  1.0 0.2  1.0 0.5 0.8 1.0  0.0
l1             0.0  0.0 0.0 0.0 0.0 0.0 0.0  0.0 1.0  1.0 0.0  1.0 1.0 1.0 1.0  0.0
"""

#: Shares by level and column.
LEVELS: dict[str, dict[str, float]] = {
    name: dict(zip(_COLUMNS.split(), map(float, values), strict=True)) for name, *values in (row.split() for row in _ROWS.strip().splitlines())
}

# A value is usual if it has this text; a field without one has usual values alone.
USUAL = {"style": "photorealistic", "layout": "single", "shot_type": None, "camera_angle": "eye", "lens_and_effect": "standard lens with deep focus"}
USUAL_OF_ELEMENT = {"composition": "full", "view_perspective": "front", "camera_angle": "eye", "visibility": None}
# Where some levels look for another text.
USUAL_BY_LEVEL = {
    **{name: {"style": "photo"} for name in ("l10", "l10_dropAllPD")},
    **{name: {"layout": "single image"} for name in ("l8.5", "l8", "l8_dropBGFG", "l7")},
    **{name: {"lens_and_effect": "standard"} for name in ("l6", "l5", "l4", "l3", "l2")},
}


def level(name: str | float) -> dict:
    """The shares of a level by its name (a whole number stands for the level of that number), and its usual texts."""
    name = f"l{name:g}" if isinstance(name, (int, float)) else name
    return LEVELS[name] | {"usual": USUAL | USUAL_BY_LEVEL.get(name, {})}
