"""Elements by atomic number."""

from __future__ import annotations

# The chemical symbols in the order of their atomic numbers, from 1.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {symbol: k for k, symbol in enumerate(SYMBOLS, 1)}


def heaviest_first(elements) -> list[str]:
    """Elements in the order of a key; an unknown symbol raises KeyError."""
    return sorted(elements, key=lambda e: -NUMBER[e])
