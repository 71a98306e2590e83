"""shadespark: perceptual colour matching and preference ranking over product catalogues, as PySpark DataFrame operators."""
