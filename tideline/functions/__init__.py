"""Column functions: log positions, clocks, masks, row images, text."""
