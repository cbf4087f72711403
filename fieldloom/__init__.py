"""fieldloom: stencil-style analytics on dense lattices and meshes, written for Spark."""
