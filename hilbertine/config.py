"""Which physics a particle table carries, and what follows from it."""

from __future__ import annotations

from dataclasses import dataclass, replace

GAS, DM1, DM2, DM3, STAR, BH, COMMON, INVALID = 0, 1, 2, 3, 4, 5, 6, 255
STAGED = 0x80
#: Metal species where a preset has chemistry.
METALS = 11


@dataclass(frozen=True)
class PhysicsConfig:
    """Switches of a table; ``checked()`` refuses a contradictory one."""

    hydro_sph: bool = True
    hydro_mfm: bool = False
    gravity_enabled: bool = True
    gravity_pm: bool = True
    gravity_adaptive: bool = False
    cooling: bool = True
    star_formation: bool = True
    stellar_winds: bool = False
    magnetic: bool = False
    divb_cleaning: bool = False
    stellar_evolution: bool = True
    n_metal_species: int = METALS
    black_holes: bool = True
    bh_spin: bool = False
    bh_kinetic_fb: bool = False
    cosmic_rays: bool = False
    cr_proton_bins: int = 0
    cr_electron_bins: int = 0
    output_potential: bool = False
    output_accel: bool = True
    force_test: bool = False

    def is_valid(self) -> bool:
        both = self.hydro_sph and self.hydro_mfm
        counts = min(self.n_metal_species, self.cr_proton_bins, self.cr_electron_bins)
        return not both and self.stellar_evolution == self.star_formation and counts >= 0

    def checked(self) -> PhysicsConfig:
        if not self.is_valid():
            raise ValueError(f"contradictory physics: {self}")
        return self

    @property
    def has_hydro(self) -> bool:
        return self.hydro_sph or self.hydro_mfm

    has_leapfrog = has_hydro

    @property
    def has_thermochemistry(self) -> bool:
        return self.stellar_evolution or self.star_formation

    @property
    def has_element_abundances(self) -> bool:
        return self.has_thermochemistry and self.n_metal_species > 0

    @property
    def has_bh_spin(self) -> bool:
        return self.black_holes and self.bh_spin

    @property
    def has_bh_kinetic_fb(self) -> bool:
        return self.black_holes and self.bh_kinetic_fb

    @property
    def has_cosmic_rays(self) -> bool:
        return self.cosmic_rays and (self.cr_proton_bins > 0 or self.cr_electron_bins > 0)

    @property
    def has_magnetized_gas(self) -> bool:
        return self.has_hydro and self.magnetic

    def has_payload(self, ptype: int) -> bool:
        """Whether rows of a type have a table of their own."""
        return {GAS: self.has_hydro, STAR: self.stellar_evolution, BH: self.black_holes}.get(ptype, False)

    def predicates(self) -> dict[str, bool]:
        names = ["has_hydro", "has_leapfrog", "has_thermochemistry", "has_element_abundances", "has_bh_spin", "has_bh_kinetic_fb", "has_cosmic_rays", "has_magnetized_gas"]
        return {"valid": self.is_valid(), **{n: getattr(self, n) for n in names}}


_full = PhysicsConfig(stellar_winds=True)
PRESETS = {
    "GravityOnly": PhysicsConfig(hydro_sph=False, cooling=False, star_formation=False, stellar_evolution=False, n_metal_species=0, black_holes=False),
    "StandardSPH": _full,
    "FullMHD": replace(_full, magnetic=True, divb_cleaning=True, bh_spin=True, bh_kinetic_fb=True, output_potential=True),
    "MFMHydro": replace(_full, hydro_sph=False, hydro_mfm=True),
}
