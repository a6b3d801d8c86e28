"""Part of the ampliq package."""
