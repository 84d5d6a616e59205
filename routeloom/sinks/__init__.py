"""Writers of run artifacts and exports."""
