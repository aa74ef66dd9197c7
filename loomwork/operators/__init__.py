"""All stages, by name."""

from .classification import Knn, KnnModel, LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, NaiveBayes, NaiveBayesModel
from .clustering import AgglomerativeClustering, KMeans, KMeansModel
from .evaluation import BinaryClassificationEvaluator
from .indexers import CountVectorizer, CountVectorizerModel, IndexToStringModel, KBinsDiscretizer, KBinsDiscretizerModel, OneHotEncoder, OneHotEncoderModel, StringIndexer, StringIndexerModel, VectorIndexer, VectorIndexerModel
from .lsh import MinHashLSH, MinHashLSHModel
from .recommendation import Swing
from .regression import LinearRegression, LinearRegressionModel
from .rowwise import DCT, Binarizer, Bucketizer, ElementwiseProduct, Interaction, Normalizer, PolynomialExpansion, RandomSplitter, SQLTransformer, VectorAssembler, VectorSlicer
from .scalers import IDF, IDFModel, Imputer, ImputerModel, MaxAbsScaler, MaxAbsScalerModel, MinMaxScaler, MinMaxScalerModel, RobustScaler, RobustScalerModel, StandardScaler, StandardScalerModel, VarianceThresholdSelector, VarianceThresholdSelectorModel
from .stats import ANOVATest, ChiSqTest, FValueTest, UnivariateFeatureSelector, UnivariateFeatureSelectorModel
from .text import FeatureHasher, HashingTF, NGram, RegexTokenizer, StopWordsRemover, Tokenizer

__all__ = [n for n in dir() if n[0].isupper()]
