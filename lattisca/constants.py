"""Lists that results depend on, as they are published."""

from __future__ import annotations

# Residue names that are ions or small additives, not ligands.
IONS = (
    "3CO ACT AG AL ALF AU AU3 BA BEF BO4 BR CA CAC CD CL CO CON CS CU EU3 F FE FE2 FLC HG IOD IR IR3 IRI IUM K LI LU MG MLI MMC MN NA NCO NH4 NI NO3 OH OHX OS PB PO4 PT PT4 RB RHD RU SE4 SM SO4 SR TB TL VO4 ZN"
).split()

# Elements that a ligand may hold, and the limits of its mass.
LIGAND_ELEMENTS = "C H N O Br Cl F P Si B Se".split()
LIGAND_MASS = (160.0, 1000.0)

# Words that mark ribosomal structures.
RIBOSOMAL = ("ribosomal", "rRNA", "50S", "30S", "60S", "40S")

# A published split of binding sites, by structure and chain.
TR60 = (
    "3sktA 5u3gB 5j02A 2yieZ 2fcyA 3gx3A 4nybA 1hr2A 4mgmB 3oxeB 1y90B 2quwB 4megB 4lvxA 4rgeB 4pcjA 3c44A 5o69A 2lwkA 3vrsA 2g5kA 5fj1C 5d5lD 4frgX 1ylsB 3q50A 4xw7A 2ktzA 4qlmA 3fu2A 5dh8B 3meiB 6fz0A 2mxsA 2nokC 1ajuA 1fypA 4k31C 1ntbA 3bnqC 5vciA 3q3zV 1uudB 1byjA 1lvjA 1utsB 1qd3A 1arjN 2l8hA 6hagA 1yrjA 1tobA 1f1tA 3tzrA 4qjhC 2kgpA 1rawA 1ehtA 1nbkA 1ei2A"
).split()
TE18 = "2pwtA 5v3fA 379dB 5bjoE 4pqvA 430dA 1nemA 1q8nA 1f1tA 2jukA 4yazR 364dC 6ez0A 2tobA 1ddyA 1fmnA 2misA 4f8uB".split()

#: Validation takes the last six of the training list; what both lists hold counts for training alone.
PUBLISHED_SPLIT = {"train": TR60[:-6], "val": TR60[-6:], "test": [x for x in TE18 if x not in TR60]}
