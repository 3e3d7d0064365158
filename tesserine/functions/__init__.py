"""Part of the tesserine engine."""
