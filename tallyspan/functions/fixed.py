"""Fixed values of the domain: chromosomes, factor colours, the motif matrix."""

#: Chromosomes that are analysed; the mitochondrial one, Y and contigs are not.
CHROMOSOMES = tuple(f"chr{k}" for k in [*range(1, 23), "X"])

#: Factor colours; the first name that an upper-cased sample name contains decides.
FACTOR_COLOURS = (
    ("H3K4ME3", "#009e73"),
    ("H3K4ME1", "#e69f00"),
    ("H3K27AC", "#D55E29"),
    ("H3K27ME3", "#0072b2"),
    ("H3K36ME3", "#9e2400"),
    ("CTCF", "#534202"),
    ("PU1", "#6E022C"),
    ("GATA1", "#9b0505"),
    ("GATA2", "#510303"),
    ("REST", "#25026d"),
    ("CJUN", "#2a0351"),
    ("FLI1", "#515103"),
    ("IGG", "#d3d3d3"),
    ("INPUT", "#d3d3d3"),
    ("DNASE", "#005212"),
    ("MNASE", "#00523b"),
    ("ATAC", "#001f07"),
    ("NAN_NAN_NAN", "#00523b"),
)
FALLBACK_COLOUR = "#00523b"

#: The CTCF motif: weights of A, C, G, T at 21 positions.
MOTIF = {
    "A": (
        0.83593967562, 0.9612721605805, 0.924068101918, 1.06685938079, 0.797339497119, 1.18221399883, 0.8166032303705,
        0.731357810088, 0.8009085680465, 0.6413220540835, 1.24263470188, 1.27537587614, 1.093537759345, 1.270194775255,
        0.607808747652, 1.1045452182715, 0.830270118282, 0.9203172509935, 0.7788696601795, 0.820042458443, 1.071536938715,
    ),
    "C": (
        1.058289907845, 0.9590219891645, 1.307638114905, 0.9474308687955, 1.625234242265, 0.703349925951, 1.126706911395,
        1.15491741682, 1.29497649068, 1.446820024825, 0.669382028924, 0.673327304706, 0.85726490824, 0.842842178544,
        1.703477693555, 0.883047249808, 0.911871662974, 1.071061400505, 1.12081896184, 1.356389737925, 1.075154356595,
    ),
    "G": (
        1.075154356595, 1.356389737925, 1.12081896184, 1.071061400505, 0.911871662974, 0.883047249808, 1.703477693555,
        0.842842178544, 0.85726490824, 0.673327304706, 0.669787971405, 1.446820024825, 1.29497649068, 1.15491741682,
        1.126706911395, 0.703349925951, 1.625234242265, 0.9474308687955, 1.307638114905, 0.9590219891645, 1.058289907845,
    ),
    "T": (
        1.071536938715, 0.820042458443, 0.7788696601795, 0.9203172509935, 0.830270118282, 1.1045452182715, 0.607808747652,
        1.270194775255, 1.093537759345, 1.27537587614, 1.21553439588, 0.6413220540835, 0.8009085680465, 0.731357810088,
        0.8166032303705, 1.18221399883, 0.797339497119, 1.06685938079, 0.924068101918, 0.9612721605805, 0.83593967562,
    ),
}
