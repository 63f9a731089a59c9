"""The SQL of all queries of the library."""

from __future__ import annotations

from mojiweave.plans.consensus_oracles import CONSENSUS_ORACLES
from mojiweave.plans.freeze_oracles import FREEZE_ORACLES
from mojiweave.plans.lattice_oracles import LATTICE_ORACLES
from mojiweave.plans.oracles import ORACLES as _PLAIN
from mojiweave.plans.phonetic_oracles import PHONETIC_ORACLES
from mojiweave.plans.study_oracles import STUDY_ORACLES

ORACLES: dict[str, str] = {**_PLAIN, **LATTICE_ORACLES, **PHONETIC_ORACLES, **FREEZE_ORACLES, **STUDY_ORACLES, **CONSENSUS_ORACLES}
