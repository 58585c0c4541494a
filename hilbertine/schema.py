"""Atoms (groups of fields), the tables made of them, and their sizes in bytes.

An atom becomes one struct column, so that column pruning reads atoms, and parts of
them, one by one. Sizes follow from alignment: a scalar starts at a multiple of its
size, an atom ends at a multiple of its alignment.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .config import PhysicsConfig

# Kinds of scalar: bytes and Spark type, by precision where it differs.
SCALARS = {
    "i1": (1, T.ShortType()), "i2": (2, T.ShortType()), "i4": (4, T.IntegerType()), "u4": (4, T.LongType()), "i8": (8, T.LongType()), "f4": (4, T.FloatType()), "f8": (8, T.DoubleType()),
}
PRECISIONS = {"single": {"real": "f4", "wide": "f4"}, "mixed": {"real": "f4", "wide": "f8"}, "double": {"real": "f8", "wide": "f8"}}
#: Rows of this many bytes are one cache line.
LINE = 64

# The fields of each atom as "name kind[*count]"; M stands for the metal species,
# P and E for the cosmic-ray bins. "real" and "wide" depend on the precision.
ATOMS = {
    "core": "pos wide*3, mass real, key i8, type i1, flags i1, time_bin i2, leaf_idx i4",
    "dyn": "vel real*3, grav_acc wide*3, old_acc real",
    "leap": "dp real*3, vel_pred real*3",
    "time": "ti_begin u4, ti_current u4, dt_step i4, grav_cost real",
    "meta": "id i8, num_ngb real, true_ngb i4",
    "potential": "potential real, pm_potential real",
    "gas_core": "hsml real, density real, pressure real, entropy real, entropy_pred real, hydro_acc wide*3, dt_entropy real, max_signal_vel real, sound_speed real",
    "gas_grad": "div_vel real, curl_vel real, dvel_matrix real*9, dhsml_density_factor real, alpha real, f_balsara real, dt_alpha real",
    "gas_mag": "B real*3, B_pred real*3, dt_B real*3, div_B real, mag_acc real*3, mag_corr real*3, phi real, phi_pred real, dt_phi real, clean_vel real",
    "gas_metal": "metals real*M, temperature real, mass_res real, egy_res real, x_cold_cloud real, egy_step real, z_smooth real",
    "gas_sf": "sfr real, delay_time real, egy_sn real, multiphase i4, out_part i4",
    "gas_mfm": "num_dens real, dhsml_numdens_factor real, dist_ngb_sqd_max real, condition_number real, alpha_slope real*5, internal_energy real, internal_energy_pred real, dt_internal_energy real, max_vel_sqr_ngb real, hydro_acc_extra wide*3, dt_entropy_extra real",
    "gas_cr": "cr_p_pressure real, cr_e_pressure real, density_old real, cr_p_norm real*P, cr_p_slope real*P, cr_p_cut real, cr_e_norm real*E, cr_e_slope real*E, cr_e_cut real",
    "star_core": "stellar_age real, last_chem_time real, initial_mass real, metals real*M, weight real, pid i4, chem_time_bin i4, mean_hsml real, mean_rho real",
    "star_meta": "z_age real, z_age_llv real, z_smooth real, contrib_snii real, contrib_snia real, contrib_agb real, stellar_phase i4, init_z real",
    "bh_core": "bh_mass wide, bh_mdot real, stellar_age real, bh_density real, bh_entropy real, surrounding_vel real*3, total_fb_eff real, accreted_mass real, accreted_bh_mass wide, accreted_mom real*3, swallow_id i8, swallow_pot real, count_progs i4, flag_merged i4, pid i4, time_bin_gas_ngb i4",
    "bh_env": "cold_density real, cold_entropy real, cold_gas_vel real*3, hot_density real, hot_entropy real, hot_gas_vel real*3, df_force real*3, df_ngb i4, sigma real, bmax real, mean_hsml real, mean_rho real",
    "bh_repos": "min_pot_pos wide*3, min_pot real, star_dens_pos wide*3, star_dens real, star_dens_vel real*3",
    "bh_spin": "spin wide*3, eta_disk real, alpha_disk real, mass_sum wide, accr_mass_sum wide, dt_sum wide, j_gas_sum wide*3, accr_counter i4, mode i4",
    "bh_kinfb": "gas_mass_cone_up real, gas_mass_cone_dn real, np_cone_up i4, np_cone_dn i4, wind_direction real*3, flag_agn_on i2, pad i2, time_agn_last real",
    "linkage": "type_idx u4, pad u4",
    # the coarse layout's common atoms
    "core_b": "pos wide*3, mass real, key i8, type i1, flags i1, time_bin i2, leaf_idx i4",
    "dyn_b": "vel real*3, grav_acc wide*3, old_acc real, pad real, vel_pred real*L",
    "aux_b": "id i8, ti_begin u4, ti_current u4, dt_step i4, grav_cost real, num_ngb real, true_ngb i4, potential real*O",
}


def fields(atom: str, config: PhysicsConfig, precision: str = "mixed") -> list[tuple[str, str, int]]:
    """(name, scalar kind, count) of an atom; count 0 is a field that doesn't exist."""
    return parsed(ATOMS[atom], config, precision)


def parsed(text: str, config: PhysicsConfig, precision: str = "mixed") -> list[tuple[str, str, int]]:
    """The fields that ``text`` lists, written as in ``ATOMS``."""
    counts = {"M": config.n_metal_species, "P": config.cr_proton_bins, "E": config.cr_electron_bins, "L": 3 * config.has_leapfrog, "O": int(config.output_potential)}
    out = []
    for item in text.split(", "):
        name, kind = item.split(" ")
        kind, _, n = kind.partition("*")
        out.append((name, PRECISIONS[precision].get(kind, kind), counts[n] if n in counts else int(n or 1)))
    return out


def struct_for(atom: str, config: PhysicsConfig, precision: str = "mixed") -> T.StructType:
    return struct_of(fields(atom, config, precision))


def struct_of(listed: list[tuple[str, str, int]]) -> T.StructType:
    out = T.StructType()
    for name, kind, n in listed:
        base = SCALARS[kind][1]
        if n:
            out.add(name, base if n == 1 and name not in ("metals",) else T.ArrayType(base, False), False)
    return out


def size_of(atom: str, config: PhysicsConfig, align: int = 8, precision: str = "mixed") -> int:
    return size_of_fields(fields(atom, config, precision), align)


def size_of_fields(listed: list[tuple[str, str, int]], align: int = 8) -> int:
    at = widest = 0
    for _, kind, n in listed:
        size = SCALARS[kind][0]
        widest = max(widest, size)
        at = -(-at // size) * size + size * n
    align = max(align, widest)
    return -(-at // align) * align


def typed_atoms(config: PhysicsConfig) -> dict[str, list[str]]:
    """The atoms of each typed table that the configuration has."""
    c = config
    gas = ["gas_core", *["gas_grad"] * c.hydro_sph, *["gas_mag"] * c.has_magnetized_gas, *["gas_metal"] * c.has_thermochemistry, *["gas_sf"] * c.star_formation, *["gas_mfm"] * c.hydro_mfm, *["gas_cr"] * c.has_cosmic_rays]
    bh = ["bh_core", "bh_env", "bh_repos", *["bh_spin"] * c.has_bh_spin, *["bh_kinfb"] * c.has_bh_kinetic_fb]
    tables = {"gas": gas if c.has_hydro else [], "star": ["star_core", "star_meta"] if c.stellar_evolution else [], "bh": bh if c.black_holes else []}
    return {k: v for k, v in tables.items() if v}


def common_atoms(config: PhysicsConfig, layout: str) -> list[str]:
    """The atoms of the common table: coarse for layout 'Bc', fine for 'B' and 'C'; the latter has no linkage."""
    if layout == "Bc":
        return ["core_b", "dyn_b", "aux_b", "linkage"]
    fine = ["core", "dyn", *["leap"] * config.has_leapfrog, "time", "meta", *["potential"] * config.output_potential]
    return fine + ["linkage"] * (layout == "B")


def schema_for(config: PhysicsConfig, layout: str = "Bc", precision: str = "mixed") -> dict[str, T.StructType]:
    """Table name -> StructType with one struct column per atom; a table that is switched off is absent."""
    config.checked()
    tables = {"common": common_atoms(config, layout), **typed_atoms(config)}
    return {t: T.StructType([T.StructField(a.removesuffix("_b"), struct_for(a, config, precision), False) for a in atoms]) for t, atoms in tables.items()}


def array_count(config: PhysicsConfig, layout: str) -> int:
    """How many arrays a container has: one per atom, or per table for the coarse typed tables."""
    typed = typed_atoms(config)
    return len(common_atoms(config, layout)) + (len(typed) if layout == "Bc" else sum(map(len, typed.values())))


def record_bytes(config: PhysicsConfig, precision: str = "mixed") -> dict[str, int]:
    """Bytes of one exchanged record: the coarse common atoms, and each typed table's atoms at 32, filled to a line."""
    common = sum(size_of(a, config, LINE, precision) for a in ("core_b", "dyn_b", "aux_b"))
    out = {"common": common, "gas": 0, "star": 0, "bh": 0}
    for table, atoms in typed_atoms(config).items():
        total = sum(size_of(a, config, 32, precision) for a in atoms)
        out[table] = -(-total // LINE) * LINE
    return out | {"legacy_fixed": common + max(out["gas"], out["star"], out["bh"])}


# Bytes of the benchmark's atoms and whole-row structs at an alignment of 64.
BENCH_COMMON = {"PCore": 64, "PDyn": 128, "PTime": 64, "PMeta": 64}
BENCH_LINKAGE = 64
BENCH_TYPED = {"gas": {"GasCore": 64, "GasGrad": 64, "GasMetal": 64, "GasSF": 64}, "star": {"StarCore": 64, "StarMeta": 64}, "bh": {"BHCore": 64, "BHEnv": 64, "BHRepos": 128}}
BENCH_WHOLE = {"gas": 448, "dm": 256, "star": 320, "bh": 448}
BENCH_COARSE_COMMON = 320
BENCH_SLOT = 16
