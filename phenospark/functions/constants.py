"""Words, tables and limits that results depend on."""

#: Words that tell methods and platforms that measure a concentration.
MIC_METHODS = ("broth dilution", "agar dilution", "microdilution", "broth microdilution")
MIC_PLATFORMS = ("vitek", "phoenix", "sensititre", "microscan", "etest", "micronaut")
#: The year from which "I" means another thing, and the classes of "I".
I_REDEFINED = 2019
I_CATEGORIES = (
    "I EUCAST >=2019 (susceptible, increased exposure)",
    "I EUCAST pre-2019/unknown-year (uncertain)",
    "I CLSI (uncertain)",
    "I other/unknown standard",
)
#: Methods and subtypes of annotation hits.
FULL_GENE_METHODS = ("EXACT", "ALLELE", "BLAST")
DEGRADED_METHODS = ("PARTIAL", "PARTIAL_CONTIG_END", "INTERNAL_STOP", "HMM")
POINT_SUBTYPES = ("POINT", "POINT_DISRUPT")

#: Species, drug, s_max and r_min in mg/L (EUCAST tables 16.1).
BREAKPOINTS = [
    ("ecoli", "ciprofloxacin", 0.25, 0.5),
    ("ecoli", "gentamicin", 2.0, 2.0),
    ("ecoli", "ampicillin", 8.0, 8.0),
    ("ecoli", "trimethoprim/sulfamethoxazole", 0.5, 0.5),
    ("ecoli", "cefotaxime", 1.0, 2.0),
]

#: Spellings and their canonical names.
SYNONYMS = [
    ("tigecyklin", "tigecycline"),
    ("tetracyklin", "tetracycline"),
    ("trimotheprim", "trimethoprim"),
    ("amoxicillin_clavulanat", "amoxicillin/clavulanic acid"),
    ("cefpodoxime_clavulanic_acid", "cefpodoxime/clavulanic acid"),
    ("sulfamethoxazole/trimethoprim", "trimethoprim/sulfamethoxazole"),
    ("cefalexin", "cephalexin"),
    ("cefalotin", "cephalothin"),
    ("cefpirom", "cefpirome"),
]

#: Canonical names accepted as they are.
CANONICAL = [
    "ciprofloxacin", "gentamicin", "ampicillin", "trimethoprim/sulfamethoxazole", "cefotaxime", "amikacin",
    "tobramycin", "kanamycin", "neomycin", "netilmicin", "streptomycin", "spectinomycin", "apramycin", "amoxicillin",
    "amoxicillin/clavulanic acid", "ampicillin/sulbactam", "carbenicillin", "piperacillin", "piperacillin/tazobactam",
    "ticarcillin", "ticarcillin/clavulanic acid", "temocillin", "penicillin", "cephalexin", "cephalothin",
    "cefazolin", "cefoxitin", "cefotetan", "cefmetazole", "cefuroxime", "cefpodoxime", "cefpodoxime/clavulanic acid",
    "ceftibuten", "cefixime", "ceftriaxone", "ceftazidime", "ceftazidime/avibactam", "ceftazidime/clavulanic acid",
    "cefotaxime/clavulanic acid", "cefepime", "cefepime_taniborbactam", "cefpirome", "cefoperazone",
    "cefoperazone/sulbactam", "cefozopran", "ceftaroline", "ceftobiprole", "ceftolozane/tazobactam", "cefiderocol",
    "ceftiofur", "cefquinome", "aztreonam", "ertapenem", "imipenem", "imipenem/relebactam", "meropenem", "doripenem",
    "sulbactam", "nalidixic acid", "norfloxacin", "ofloxacin", "levofloxacin", "moxifloxacin", "delafloxacin",
    "gemifloxacin", "colistin", "polymyxin b", "tetracycline", "doxycycline", "minocycline", "oxytetracycline",
    "tigecycline", "azithromycin", "erythromycin", "clarithromycin", "clindamycin", "spiramycin", "lincomycin",
    "chloramphenicol", "florfenicol", "fosfomycin", "nitrofurantoin", "trimethoprim", "sulfamethoxazole",
    "sulfisoxazole", "rifampin", "rifaximin", "daptomycin", "linezolid", "metronidazole", "teicoplanin", "vancomycin",
]


def canonical_names() -> list[str]:
    return sorted(CANONICAL)


#: Drug, rule, subtype, symbol, class and subclass patterns, confidence, component.
#: The order within a drug is the order in which rules are tried.
_BOTH_3GC = [
    ("ctxm_esbl", "AMR", r"^blaCTX-M-", None, None, "confirmed", None),
    ("acquired_ampc", "AMR", r"^bla(CMY|DHA|ACC|ACT|MIR|MOX|FOX|LAT|CMH)-", None, None, "confirmed", None),
    ("carbapenemase_with_3gc_activity", "AMR", r"^bla(KPC|NDM|VIM|IMP)-", None, None, "confirmed", None),
    ("esbl_cephalosporinase_subclass", "AMR", None, r"^BETA-LACTAM$", r"CEPHALOSPORIN", "confirmed", None),
    ("oxa_cephalosporin_subclass", "AMR", r"^blaOXA-", None, r"CEPHALOSPORIN", "review", None),
    ("ampC_regulatory_points", "POINT", r"^ampC_", None, None, "confirmed", None),
    ("ftsI_pbp3_points", "POINT", r"^ftsI_", None, None, "review", None),
]
EVIDENCE_RULES = {
    "ciprofloxacin": [
        ("qrdr_point_mutations", "POINT", r"^(gyrA|gyrB|parC|parE)_", r"^QUINOLONE", None, "confirmed", None),
        ("qnr_genes", "AMR", r"^qnr", None, None, "confirmed", None),
        ("qepA_efflux", "AMR", r"^qepA", None, None, "confirmed", None),
        ("aac6_Ib_cr", "AMR", r"^aac\(6'\)-Ib-cr", None, None, "confirmed", None),
        ("oqxab_efflux", "AMR", r"^oqx(A|B)", None, None, "review", None),
        ("efflux_regulator_points", "POINT", r"^(marR|soxR|soxS|acrR)_", None, None, "review", None),
    ],
    "gentamicin": [
        ("ame_gentamicin_subclass", "AMR", None, r"AMINOGLYCOSIDE", r"GENTAMICIN", "confirmed", None),
        ("rmt_npm_16S_methyltransferases", "AMR", r"^(rmt[A-Z]|npmA)", None, None, "confirmed", None),
        ("aph3_II_VI_gentamicin", "AMR", r"^aph\(3'\)-(IIa|IIb|VIa|VIb)$", None, None, "review", None),
        ("aac3_rare_environmental", "AMR", r"^aac\(3\)-(IXa|VIIa|VIIIa|Xa)$", None, None, "review", None),
    ],
    "ampicillin": [("any_acquired_betalactamase", "AMR", None, r"^BETA-LACTAM$", None, "confirmed", None)],
    "cefotaxime": _BOTH_3GC,
    "ceftazidime": _BOTH_3GC,
    "meropenem": [
        ("carbapenemase_subclass", "AMR", None, r"^BETA-LACTAM$", r"CARBAPENEM", "confirmed", None),
        ("porin_loss_points", "POINT", r"^(ompC|ompF|ompR)_", None, None, "review", None),
    ],
    "trimethoprim-sulfamethoxazole": [
        ("dfr_trimethoprim", "AMR", None, None, r"^TRIMETHOPRIM$", "confirmed", "trimethoprim"),
        ("sul_sulfonamide", "AMR", None, None, r"^SULFONAMIDE$", "confirmed", "sulfamethoxazole"),
        ("folP_points", "POINT", r"^folP_", None, None, "confirmed", "sulfamethoxazole"),
    ],
}
#: Symbols that count for nothing, by drug.
EVIDENCE_EXCLUDED = {"ampicillin": r"^(blaEC|blaOXA-(53|74)$)", "cefotaxime": r"^blaEC", "ceftazidime": r"^blaEC"}
#: Other names of drugs.
DRUG_ALIASES = {
    "sxt": "trimethoprim-sulfamethoxazole",
    "trimethoprim/sulfamethoxazole": "trimethoprim-sulfamethoxazole",
    "trimethoprim_sulfamethoxazole": "trimethoprim-sulfamethoxazole",
}

#: K-mers of a locus, assembly limits, error rates of bands, similarity limits, shares of splits.
KMER, KMERS_PER_LOCUS, CALLABLE_SHARE, CALLABLE_SHARE_DEMO = 31, 48, 0.75, 0.30
QC_BASES, QC_CONTIGS, QC_CONTIGS_LOOSE = (4_000_000, 6_000_000), 500, 800
ALPHA_S, ALPHA_R, DISTANCE_QUANTILE = 0.02, 0.10, 0.99
ANI, ALIGNED_FRACTION, HELDOUT_CLUSTERS = 99.5, 80.0, 5
SPLIT_SHARES = {"train": 0.70, "calibration": 0.15, "test": 0.15}
