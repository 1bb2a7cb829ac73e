"""The token contract and the constants of the domain. Values here are fixed by the token ids they give."""

from __future__ import annotations

import numpy as np

#: Id ranges (first, last) and specials of the token contract.
RANGES = {"delta": (0, 127), "pitch": (128, 215), "duration": (216, 343), "velocity": (344, 359)}
PAD, BOS, EOS = 360, 361, 362
DENSITY, VOICES, REGISTER = 363, 367, 371
VOCABULARY, EVENT = 374, 4
LOW_PITCH, HIGH_PITCH = 21, 108
DEFAULT_QUARTILES = (1.0, 2.5, 5.0)

#: Log-spaced bin edges in seconds; both engines use these very numbers, never a closed form.
DELTA_EDGES = np.logspace(np.log10(1e-4), np.log10(8.0), 128).tolist()
DURATION_EDGES = np.logspace(np.log10(1 / 64), np.log10(8.0), 129).tolist()
DELTA_CENTRES = [0.0, *(float(np.sqrt(a * b)) for a, b in zip(DELTA_EDGES, DELTA_EDGES[1:], strict=False))]
DURATION_CENTRES = [float(np.sqrt(a * b)) for a, b in zip(DURATION_EDGES, DURATION_EDGES[1:], strict=False)]

#: Source profiles (weight, share of the raw corpus, least seconds, velocity rule, least notes, least pitches, dominance).
#: Note and pitch limits fit the event tables (a user has 49 to 86 events).
PROFILES = {
    "maestro": (1.5, 0.056, 30.0, True, 55, 40, 0.70),
    "giant_midi": (1.2, 0.106, 30.0, True, 55, 40, 0.70),
    "aria_midi": (1.0, 0.796, 20.0, True, 55, 40, 0.70),
    "adl_piano": (1.3, 0.042, 15.0, False, 55, 40, 0.70),
}
PROFILE_COLUMNS = ("source", "sample_weight", "raw_share", "min_seconds", "filter_velocity", "min_notes", "min_pitches", "dominance")
#: Other names of the sources.
ALIASES = {"aria": "aria_midi", "giant": "giant_midi", "giantmidi": "giant_midi", "adl": "adl_piano", "adl_piano_midi": "adl_piano", "maestro_v3": "maestro"}
