"""scatterlake: scattering-tomography analytics expressed as Spark plans."""
