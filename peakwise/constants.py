"""Fixed values shared by the operators: masses, vocabularies, word lists."""

# Mass of the most common isotope of each element (unified atomic mass units).
ISOTOPE_MASS = {
    "H": 1.00782503223, "B": 11.00930536, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957,
    "F": 18.99840316273, "Na": 22.989769282, "Si": 27.97692653465, "P": 30.97376199842, "S": 31.9720711744,
    "Cl": 34.968852682, "K": 38.9637064864, "Se": 79.9165218, "Br": 78.9183376, "I": 126.9044719,
}
ELECTRON_MASS = 0.00054858
NEUTRON_MASS = 1.008665
PROTON_MASS = 1.007276466812

# Element order of formula vectors.
FORMULA_ELEMENTS = ("H", "C", "N", "O", "F", "P", "S", "Cl", "Br", "I")
HALOGENS = ("F", "Cl", "Br", "I")

_H, _C, _N, _O, _NA = (ISOTOPE_MASS[e] for e in ("H", "C", "N", "O", "Na"))

# m/z shift of a neutral mass per adduct.  The water-loss entry
# is the one consistent with its formula change (-H -O), two hydrogens lighter
# than a shift of +H -O.
ADDUCT_MASS_SHIFT = {
    "[M+H]+": _H - ELECTRON_MASS,
    "[M-H]-": -_H + ELECTRON_MASS,
    "[M+Na]+": _NA - ELECTRON_MASS,
    "[M+NH4]+": _N + 4 * _H - ELECTRON_MASS,
    "[M-H2O+H]+": -_H - _O - ELECTRON_MASS,
    "[M]+": -ELECTRON_MASS,
    "": 0.0,
    "[M+H]+_NL": -_H + ELECTRON_MASS,
    "[M-H]-_NL": _H - ELECTRON_MASS,
}

# Shifts used to infer a missing precursor m/z.
PRECURSOR_INFERENCE_SHIFT = {
    "[M+HCOO]-": _H + _C + 2 * _O + ELECTRON_MASS,
    "[M]+": -ELECTRON_MASS,
    "[M+HOO]-": _H + 2 * _O + ELECTRON_MASS,
    "[M-OH]+": -_H - _O - ELECTRON_MASS,
    "[M+H-C12H20O9]+": -19 * _H - 12 * _C - 9 * _O - ELECTRON_MASS,
    "[M-H]-": -_H + ELECTRON_MASS,
    "[M+H]+": _H - ELECTRON_MASS,
    "[M+Na]+": _NA - ELECTRON_MASS,
}

# Peak shift per adduct spelling when candidates are rendered as ions.
CANDIDATE_ADDUCT_SHIFT = {
    "[M+H]+": PROTON_MASS, "M+H": PROTON_MASS, "[M]+": 0.0, "M+": 0.0, "[M+NA]+": 22.989218, "[M+K]+": 38.963158,
}

# Factor applied to the normalised collision energy per charge.
CHARGE_FACTOR = {1: 1.0, 2: 0.9, 3: 0.85, 4: 0.8, 5: 0.75}

# Instrument words for which a bare number means normalised energy.
NCE_INSTRUMENTS = ("orbitrap", "lc-esi-qft", "lc-apci-itft", "linear ion trap", "lc-esi-itft", "itft")

# Instrument type string -> class.
INSTRUMENT_TYPE_CLASS = {
    "QTOF": "QTOF", "FT": "FT", "Q-TOF": "QTOF", "HCD": "FT", "QqQ": "QQQ", "QqQ/triple quadrupole": "QQQ",
    "IT/ion trap": "IT", "IT-FT/ion trap with FTMS": "FT", "Q-ToF (LCMS)": "QTOF", "Bruker Q-ToF (LCMS)": "QTOF",
    "ESI-QTOF": "QTOF", "ESI-QFT": "FT", "ESI-ITFT": "FT", "Linear Ion Trap": "IT", "LC-ESI-QTOF": "QTOF",
    "LC-ESI-QFT": "FT", "LC-ESI-QQQ": "QQQ", "LC-Q-TOF/MS": "QTOF", "LC-ESI-ITFT": "FT", "LC-ESI-IT": "IT",
    "LC-QTOF": "QTOF", "qToF": "QTOF", "Unknown (LCMS)": "Other", "Ion Trap (LCMS)": "IT",
    "Orbitrap (LCMS)": "FT", "FTICR (LCMS)": "FT", "ITFT": "FT", "Orbitrap": "FT", "QFT": "FT",
}
# Instrument name -> class, used when the type is missing.
INSTRUMENT_NAME_CLASS = {"Maxis II HD Q-TOF Bruker": "QTOF", "qToF": "QTOF", "Orbitrap": "FT"}

# Encoder vocabularies.
ADDUCT_VOCABULARY = {"[M+H]+": 1, "[M+Na]+": 2, "[M+K]+": 3, "[M-H]-": 4, "[M+NH4]+": 5}
INSTRUMENT_VOCABULARY = {"orbitrap": 1, "qtof": 2, "tof": 3, "iontrap": 4, "fticr": 5, "triplequad": 6}

# Neutral losses looked up from a parent formula.
COMMON_LOSSES = (
    "H2O", "NH3", "CO", "CO2", "CH2O", "HCN", "C2H4", "H2S", "SO2", "CH4", "C2H2", "C2H6", "NO", "NO2",
)
# The losses whose exact match is rewarded by the prior score.
PRIOR_LOSSES = ("H2O", "NH3", "CO", "CO2", "CH2O", "HCN", "C2H4", "H2S", "SO2")
# Masses of H2O, NH3, CO, CO2, CH2O, C2H4 used for the prior's Gaussian bonus.
PRIOR_LOSS_MASSES = (18.0106, 17.0265, 27.9949, 43.9898, 30.0106, 28.0313)

# Isotope channels of the substitution envelope:
# (element, abundance, nominal shift, mass difference to the base isotope).
ISOTOPE_CHANNELS = (
    ("H", 0.000115, 1, 2.01410177812 - 1.00782503223),
    ("C", 0.0107, 1, 13.00335483507 - 12.0),
    ("N", 0.00364, 1, 15.00010889888 - 14.00307400443),
    ("O", 0.00038, 1, 16.9991317565 - 15.99491461957),
    ("O", 0.00205, 2, 17.99915961286 - 15.99491461957),
    ("S", 0.0079, 1, 32.9714589098 - 31.9720711744),
    ("S", 0.0421, 2, 33.967867004 - 31.9720711744),
    ("Cl", 0.2422, 2, 36.965902602 - 34.968852682),
    ("Br", 0.4931, 2, 80.9162897 - 78.9183376),
)
# Fixed values: +1 and +2 abundances of the Poisson envelope (other numbers than above on purpose).
POISSON_PLUS1 = {"H": 0.00015, "C": 0.0107, "N": 0.00364, "O": 0.00038, "S": 0.0079}
POISSON_PLUS2 = {"O": 0.00205, "S": 0.0421, "Cl": 0.2422, "Br": 0.4931}
